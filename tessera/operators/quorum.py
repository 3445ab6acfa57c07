"""Replica results: the quorum on equal checksums, what comes too late, what is undecided, progress and assignment."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decisions(votes: DataFrame, k: int, value: Column | None = None) -> DataFrame:
    """votes: chunk, checksum, client, ts, event_id, status. Returns a row a chunk: checksum and (ts, event_id) of the vote that completes
    the first group of k distinct clients with equal checksums, null if none does; number of votes and of failed ones.

    A client's repeated vote for a checksum counts once, failed replicas don't vote. value: what is compared instead of the checksum (a
    rounded number, for floats that differ in their last bits)."""
    v = votes.withColumn("key", F.coalesce(value, F.col("checksum")) if value is not None else F.col("checksum"))
    ok = v.where("status = 'ok'")
    first = ok.groupBy("chunk", "key", "client").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    order = Window.partitionBy("chunk", "key").orderBy("at")
    reached = first.withColumn("n", F.row_number().over(order)).where(F.col("n") == k)
    won = reached.groupBy("chunk").agg(F.min(F.struct("at", "key")).alias("w"))
    all_of = v.groupBy("chunk").agg(F.count("*").alias("n_votes"), F.count_if(F.col("status") != "ok").alias("n_failed"))
    return all_of.join(won, "chunk", "left").select("chunk", "n_votes", "n_failed", F.col("w.key").alias("checksum"), F.col("w.at.ts").alias("decided_ts"), F.col("w.at.event_id").alias("decided_id"))


def accepted(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("checksum").isNotNull())


def undecided(decided: DataFrame) -> DataFrame:
    return decided.where(F.col("checksum").isNull()).select("chunk", "n_votes", "n_failed")


def late(votes: DataFrame, decided: DataFrame) -> DataFrame:
    """Votes after their chunk was decided."""
    d = accepted(decided).select("chunk", "decided_ts", "decided_id")
    return votes.join(d, "chunk").where(F.struct("ts", "event_id") > F.struct("decided_ts", "decided_id")).select("chunk", "event_id", "client", "checksum")


def orphans(votes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Votes for chunks that no task has."""
    return votes.join(chunks.select("chunk"), "chunk", "left_anti").select("chunk", "event_id")


def progress(decided: DataFrame, task: Column) -> DataFrame:
    """A row a task: chunks, completed ones, whether all are."""
    return decided.groupBy(task.alias("task")).agg(F.count("*").alias("chunks"), F.count_if(F.col("checksum").isNotNull()).alias("completed"), F.bool_and(F.col("checksum").isNotNull()).alias("all_done"))


def stuck(votes: DataFrame, decided: DataFrame, now: Column, limit_s: int) -> DataFrame:
    """Undecided chunks whose last vote is older than the limit: what a timeout would deal out again."""
    open_chunks = decided.where(F.col("checksum").isNull()).select("chunk")
    last = votes.groupBy("chunk").agg(F.max("ts").alias("last_ts"))
    idle = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) / 1000000)
    return last.join(open_chunks, "chunk", "left_semi").select("chunk", idle.alias("idle_s")).where(F.col("idle_s") > limit_s)


def affected(votes: DataFrame, decided: DataFrame, client: int) -> DataFrame:
    """Undecided chunks that a client that left had a part in."""
    own = votes.where(F.col("client") == client).select("chunk")
    return decided.where(F.col("checksum").isNull()).join(own, "chunk", "left_semi").select("chunk")


def assigned(chunks: DataFrame, clients: DataFrame, k: int, earlier: DataFrame | None = None, same_client: bool = False) -> DataFrame:
    """Each chunk (chunk, framework) to k distinct clients (client, frameworks, capacity, in_flight) that know its framework, the least loaded
    first: (chunk, replica, client). Ties go to the smaller client. A framework's clients are one list, which meets its chunks by an equi-join. Clients that name no
    framework (null or an empty list) take chunks of any.

    A chunk starts at a place of its own in the list, so that chunks spread over clients. earlier: (chunk, client) that have been dealt before; unless same_client, a
    chunk passes by the clients that had it, and replicas are numbered on. Loads are those of the moment: what is dealt here takes up capacity in the next call."""
    free = clients.where(F.col("in_flight") < F.col("capacity"))
    load = (F.col("in_flight") / F.greatest("capacity", F.lit(1))).alias("load")
    named = free.select(F.explode("frameworks").alias("framework"), load, "client").distinct()
    open_to_all = free.where(F.coalesce(F.size("frameworks"), F.lit(-1)) <= 0).select(load, "client")
    kinds = chunks.select("framework").distinct().withColumn("one", F.lit(1))
    ranked = named.unionByName(kinds.join(open_to_all.withColumn("one", F.lit(1)), "one").select("framework", "load", "client"))
    lists = ranked.groupBy("framework").agg(F.array_sort(F.collect_list(F.struct("load", "client"))).alias("fit"))
    fit = chunks.join(lists, "framework").select("chunk", "fit")
    if earlier is not None:
        had = earlier.groupBy("chunk").agg(F.collect_set("client").alias("had"), F.count("*").alias("dealt"))
        fit = fit.join(had, "chunk", "left").select("chunk", F.coalesce("dealt", F.lit(0)).alias("dealt"), "fit" if same_client else F.when(F.col("had").isNull(), F.col("fit")).otherwise(F.filter("fit", lambda c: ~F.array_contains("had", c["client"]))).alias("fit"))
        fit = fit.where(F.size("fit") > 0)
    else:
        fit = fit.withColumn("dealt", F.lit(0))
    n = F.size("fit")
    picked = fit.select("chunk", n.alias("n"), "fit", "dealt", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), n) - 1)).alias("replica"))
    return picked.select("chunk", (F.col("dealt") + F.col("replica")).cast("long").alias("replica"), F.element_at("fit", (F.pmod(F.col("chunk") + F.col("replica"), F.col("n")) + 1).cast("int"))["client"].alias("client"))


def scheduled(chunks: DataFrame, clients: DataFrame, k: int, earlier: DataFrame | None = None, same_client: bool = False) -> DataFrame:
    """What is sent out now: chunks (chunk, framework), the smallest first, each to up to k clients with a place left, the least loaded first (ties to the smaller client);
    a place is taken up as it is dealt. Returns (chunk, replica, client). Frameworks, earlier and same_client as in assigned().

    Of the chunks that the same clients can take no more can be served than there are places in all, so only these come together in one task, however many chunks wait."""
    free = clients.where(F.col("in_flight") < F.col("capacity")).select("client", "frameworks", "capacity", "in_flight")
    places = free.agg(F.coalesce(F.sum(F.col("capacity") - F.col("in_flight")), F.lit(0)).cast("long").alias("n")).first().n
    had = (earlier if earlier is not None else chunks.sparkSession.createDataFrame([], "chunk long, client long")).groupBy("chunk").agg(F.collect_set("client").alias("had"), F.count("*").alias("dealt"))
    names = F.coalesce(F.size("frameworks"), F.lit(-1)) <= 0
    able = free.select(F.explode(F.when(names, F.array(F.lit(None).cast("string"))).otherwise(F.col("frameworks"))).alias("of"), "client").distinct()
    any_of = able.where("of is null").agg(F.collect_set("client").alias("any"), F.lit(1).alias("one"))
    named = able.where("of is not null").groupBy("of").agg(F.collect_set("client").alias("fit"))
    none = F.array().cast("array<bigint>")
    waiting = chunks.join(had, "chunk", "left").withColumn("one", F.lit(1)).join(F.broadcast(any_of), "one").join(F.broadcast(named), F.col("framework") == F.col("of"), "left")
    able_now = F.array_union(F.coalesce("fit", none), "any")
    waiting = waiting.withColumn("able", F.array_sort(able_now if same_client else F.array_except(able_now, F.coalesce("had", none)))).where(F.size("able") > 0)
    first = waiting.withColumn("nth", F.row_number().over(Window.partitionBy("framework", "able").orderBy("chunk"))).where(F.col("nth") <= places)
    one = first.select(F.struct("chunk", "framework", F.coalesce("dealt", F.lit(0)).alias("dealt"), "had").alias("of")).agg(F.sort_array(F.collect_list("of")).alias("chunks"), F.lit(1).alias("one"))
    both = one.join(F.broadcast(free.agg(F.collect_list(F.struct("client", "frameworks", "capacity", "in_flight")).alias("clients"), F.lit(1).alias("one"))), "one")

    def deal(batches):
        for batch in batches:
            for waiting, given in zip(batch.column("chunks").to_pylist(), batch.column("clients").to_pylist(), strict=True):
                load, out = {c["client"]: c["in_flight"] for c in given}, []
                for w in waiting:
                    had, replica = set(w["had"] or ()), w["dealt"]
                    for _ in range(k):
                        fit = [c for c in given if load[c["client"]] < c["capacity"] and (not c["frameworks"] or w["framework"] in c["frameworks"]) and (same_client or c["client"] not in had)]
                        if not fit:
                            break
                        best = min(fit, key=lambda c: (load[c["client"]] / max(c["capacity"], 1), c["client"]))["client"]
                        out.append((w["chunk"], replica, best))
                        load[best] += 1
                        had.add(best)
                        replica += 1
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*out, strict=True) if out else [[]] * 3)], ["chunk", "replica", "client"])

    return both.select("chunks", "clients").mapInArrow(deal, "chunk long, replica long, client long")


def load_rank(clients: DataFrame) -> DataFrame:
    """Clients by load, the least loaded first."""
    load = F.col("in_flight") / F.greatest("capacity", F.lit(1))
    return clients.select("client", "in_flight", "capacity", load.alias("load")).withColumn("rank", F.row_number().over(Window.orderBy("load", "client")).cast("long"))

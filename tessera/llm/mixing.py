"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document gets a rate r, the number of times it is repeated. Among all rates that give every source its target of
tokens (sum size * r) and stay between 0 and the cap, entropy balancing takes those nearest to the base rates q in relative
entropy, sum r log(r / q) - r + q over the documents. The dual is convex with one multiplier a source, and its solution is
exponentially tilted by a document's tokens: r = min(cap, q exp(multiplier * size / scale)), scale being the source's
token-weighted mean size. Newton's iterations solve the dual; each is one aggregation over the distinct (source, size, base)
with their counts: tokens mixed so far, and their derivative, the Hessian's diagonal (sources share no document, so it has
no other entries). The step is taken on the logit of the mixed share of what the cap allows, which is nearly straight in the
multiplier, within a bracket that every round tightens. What moves is a row a source; what reaches the driver is whether one
is left to settle. A weighted entropy, sum size * (...), whose tilt is the same for all documents of a source, is an option.

Rates become copies by systematic rounding: within a source, in chunks of about `chunk_rows` documents dealt by a hash
of the id, documents stand in order of size, and each takes the whole numbers that the running sum of its fractions
passes; what the chunk still lacks or has too much of is made up by single copies of its small documents first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sorting import positioned
from ._shared import WORD, dropped, table, written

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes: source, size. Returns source, source_size, n_docs, target: `share` of all tokens by weight, sources in order of code points with null last; a target stops at `cap` times its source's size, and the excess is shared again by weight until none is above. share must not exceed cap."""
    if share > cap:
        raise ValueError("the share must not exceed the cap")
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sums = positioned(sums, F.col("source").asc_nulls_last(), pos="turn")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
    sources = written(sums.select("source", "source_size", "n_docs", weight.alias("weight"), (F.col("source_size") * cap).alias("most")), "sources")
    level = 0.0
    while True:  # every pass caps a source more or is the last; one row comes back
        stopped = F.col("weight") * level >= F.col("most") if level else F.lit(False)
        left, w = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * share - F.coalesce(F.sum(F.when(stopped, F.col("most"))), F.lit(0.0)), F.sum(F.when(~stopped, F.col("weight")))).first()
        step = float(left) / w if w else level
        if not w or step <= level * (1 + 1e-12):
            break
        level = step
    return sources.select("source", "source_size", "n_docs", F.least(F.col("weight") * level, "most").alias("target"))


def tilted(base: Column, multiplier: Column, reach: Column, cap: float) -> Column:
    """min(cap, base exp(multiplier * reach)); the exponent is held where doubles are."""
    return F.least(F.lit(float(cap)), base * F.exp(F.least(F.lit(700.0), multiplier * reach)))


def exact_sum(x: Column) -> Column:
    """The sum of doubles as decimals, which no order of rows changes, so that reruns agree to the last bit."""
    return F.sum(x.cast("decimal(28,12)")).cast("double")


def balanced_rates(sizes: DataFrame, targets: DataFrame, cap: float = 2.0, tolerance: float = 1e-9, rounds: int = 80, by_size: bool = False) -> DataFrame:
    """sizes: source, size, base (q > 0). targets: source, target (at most cap times the source's size). Returns source, multiplier, scale: the dual's solution, by_size for plain entropy (r = min(cap, q exp(multiplier * size / scale))), else for token-weighted entropy (r = min(cap, q exp(multiplier))). Sources without tokens keep multiplier 0."""
    if by_size:
        counts = sizes.where("size > 0").groupBy("source", "base", "size").agg(F.count("*").alias("n"))
        groups = written(counts.select("source", "base", (F.col("n") * F.col("size")).cast("double").alias("tokens"), F.col("size").cast("double").alias("size")), "groups")
    else:
        groups = written(sizes.where("size > 0").groupBy("source", "base").agg(F.sum("size").cast("double").alias("tokens")).withColumn("size", F.lit(1.0)), "groups")
    scale = exact_sum(F.col("tokens") * F.col("size")) / exact_sum(F.col("tokens"))
    # at the multiplier `high` the last document is capped and the dual turns flat
    own = groups.groupBy(F.col("source").alias("of")).agg(scale.alias("scale"), exact_sum(F.col("tokens")).alias("all"), F.max(F.log(cap / F.col("base")) / F.col("size")).alias("last"))
    high = F.col("last") * F.col("scale")
    full = F.col("target") >= F.col("all") * cap * (1 - tolerance)
    dual = targets.select("source", "target").join(own, F.col("source").eqNullSafe(F.col("of")))
    dual = written(dual.select("source", "target", "scale", "all", F.lit(None).cast("double").alias("low"), high.alias("high"), F.when(full, high).otherwise(F.least(F.lit(0.0), high)).alias("multiplier")), "dual")
    for _ in range(rounds):
        reach = F.col("size") / F.col("scale")
        rate = tilted(F.col("base"), F.col("multiplier"), reach, cap)
        mixed, slope = F.col("tokens") * rate, F.when(rate < cap, F.col("tokens") * rate * reach).otherwise(0.0)
        each = groups.join(dual.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        sums = each.groupBy("source", "target", "scale", "all", "low", "high", "multiplier").agg(exact_sum(mixed).alias("mixed"), exact_sum(slope).alias("slope"))
        now, most = F.col("multiplier"), F.col("all") * cap
        gap = F.col("target") - F.col("mixed")
        settled = F.abs(gap) <= tolerance * F.col("target")
        low, high = F.when(gap > 0, now).otherwise(F.col("low")), F.when(gap < 0, F.least("high", now)).otherwise(F.col("high"))
        logit = lambda x: F.log(F.col(x) / (most - F.col(x)))  # noqa: E731, B023
        newton = F.when((F.col("slope") > 0) & (F.col("mixed") < most), now + (logit("target") - logit("mixed")) * F.col("mixed") * (most - F.col("mixed")) / (F.col("slope") * most))
        inside = (newton < high) & (low.isNull() | (newton > low))
        step = F.when(inside, newton).when(low.isNull(), 2 * F.least(now, F.lit(0.0)) - 1).otherwise((low + high) / 2)
        moved = written(sums.select("source", "target", "scale", "all", low.alias("low"), high.alias("high"), F.when(settled, now).otherwise(step).alias("multiplier"), settled.alias("settled")), "dual")
        dropped(dual)
        dual = moved
        if moved.where("not settled").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("the multipliers did not settle")
    dropped(groups)
    alone = targets.join(dual.select(F.col("source").alias("of")).withColumn("there", F.lit(True)), F.col("source").eqNullSafe(F.col("of")), "left").where("there is null")
    return dual.select("source", "multiplier", "scale").unionByName(alone.select("source", F.lit(0.0).alias("multiplier"), F.lit(1.0).alias("scale")))


#: Groups that may cut across the sources at most: the one matrix that the driver solves is of this size.
MOST_GROUPS = 200
#: Shares of a Newton step that are tried at once.
SHARES = tuple(0.5**k for k in range(12))


def solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small system by elimination with pivots; directions in which the matrix is flat keep 0."""
    n = len(right)
    rows = [[*m, r] for m, r in zip(matrix, right, strict=True)]
    small = 1e-12 * max([1e-300, *(abs(x) for m in matrix for x in m)])
    pivots: list[int | None] = []
    at = 0
    for c in range(n):
        best = max(range(at, n), key=lambda k: abs(rows[k][c]), default=None)
        if best is None or abs(rows[best][c]) <= small:
            pivots.append(None)
            continue
        rows[at], rows[best] = rows[best], rows[at]
        for k in range(n):
            if k != at and rows[k][c]:
                f = rows[k][c] / rows[at][c]
                rows[k] = [x - f * y for x, y in zip(rows[k], rows[at], strict=True)]
        pivots.append(at)
        at += 1
    return [0.0 if p is None else rows[p][n] / rows[p][c] for c, p in enumerate(pivots)]


def balanced_jointly(sizes: DataFrame, targets: DataFrame, also: DataFrame, cap: float = 2.0, tolerance: float = 1e-8, rounds: int = 100) -> tuple[DataFrame, DataFrame, float]:
    """Entropy balancing under token targets of sources and, cutting across them, of groups such as languages: r = min(cap, q exp((l + m) size / scale)).

    sizes: source, grp, size, base (q > 0); targets: source, target; also: grp, target (MOST_GROUPS rows at most), both above 0 and of one sum, and such that some rates
    between 0 and the cap meet them. Returns (source, l), (grp, m) and the scale. Sources and groups without tokens are left out.

    Each round is a full Newton step of the dual: sources touch each other only through groups, so their part of the Hessian is a diagonal, which is
    eliminated in one aggregation; the driver solves what is left, a matrix of groups by groups, and the sources' steps follow from it. Of several shares of the
    step, evaluated in one aggregation, the one that lowers the dual most is taken."""
    kept = sizes.where("size > 0")
    scale = float(kept.agg(F.sum(F.col("size").cast("double") * F.col("size")) / F.sum("size")).first()[0] or 1.0)
    x = (F.col("size") / scale).alias("x")
    cells = written(kept.groupBy("source", "grp", "base", "size").agg(F.count("*").cast("double").alias("n")).select("source", "grp", "base", "n", x), "cells")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    of_source = targets.join(cells.select(F.col("source").alias("of")).distinct(), same("source", "of"), "left_semi")
    of_group = also.join(cells.select(F.col("grp").alias("of")).distinct(), same("grp", "of"), "left_semi")
    l = written(of_source.select("source", (F.col("target") / scale).alias("target"), F.lit(0.0).alias("l"), F.lit(0.0).alias("dl")), "dual")  # noqa: E741
    m = [(r.grp, r.target / scale, 0.0) for r in of_group.select("grp", F.col("target").cast("double").alias("target")).limit(MOST_GROUPS + 1).collect()]
    if len(m) > MOST_GROUPS:
        raise ValueError(f"at most {MOST_GROUPS} groups may cut across the sources")
    kind = f"h {dict(also.dtypes)['grp']}, u double, m double, dm double"
    spark = sizes.sparkSession
    groups = lambda steps: F.broadcast(spark.createDataFrame([(g, u, v, d) for (g, u, v), d in zip(m, steps, strict=True)], kind))

    def placed(steps: list[float]) -> DataFrame:
        return cells.join(l.withColumnRenamed("source", "s"), same("source", "s")).join(groups(steps), same("grp", "h"))

    for _ in range(rounds):
        now = F.col("l") + F.col("m")
        rate = tilted(F.col("base"), now, F.col("x"), cap)
        pull, bend = F.col("n") * F.col("x") * rate, F.when(rate < cap, F.col("n") * F.col("x") * F.col("x") * rate).otherwise(0.0)
        each = written(placed([0.0] * len(m)).groupBy("source", "target", "grp").agg(exact_sum(pull).alias("pull"), exact_sum(bend).alias("bend")), "steps")
        total = each.groupBy(F.col("source").alias("s")).agg((F.max("target") - exact_sum(F.col("pull"))).alias("gap"), F.max("target").alias("full"), (exact_sum(F.col("bend")) + 1e-9 * F.max("target")).alias("d"))
        both = each.join(total, same("source", "s"))
        pairs = both.select("s", "grp", "bend", "d").join(both.select(F.col("s").alias("z"), F.col("grp").alias("g2"), F.col("bend").alias("b2")), same("s", "z"))
        cross = {(r.grp, r.g2): r.c for r in pairs.groupBy("grp", "g2").agg(exact_sum(F.col("bend") * F.col("b2") / F.col("d")).alias("c")).collect()}  # groups by groups
        own = {r.grp: r for r in both.groupBy("grp").agg(exact_sum(F.col("pull")).alias("pull"), exact_sum(F.col("bend")).alias("bend"), exact_sum(F.col("bend") * F.col("gap") / F.col("d")).alias("from_sources")).collect()}
        worst = total.agg(F.max(F.abs("gap") / F.col("full")).alias("w")).first().w
        worst = max([worst or 0.0, *(abs(u - own[g].pull) / u for g, u, _ in m)])
        if worst <= tolerance:
            dropped(each, cells)
            return l.select("source", "l"), spark.createDataFrame([(g, v) for g, _, v in m], f"grp {dict(also.dtypes)['grp']}, m double"), scale
        matrix = [[(own[g].bend + 1e-9 * u if g == h else 0.0) - cross.get((g, h), 0.0) for h, _, _ in m] for g, u, _ in m]
        dm = solved(matrix, [u - own[g].pull - own[g].from_sources for g, u, _ in m])
        back = both.join(groups(dm), same("grp", "h")).groupBy("s").agg(((F.max("gap") - exact_sum(F.col("bend") * F.col("dm"))) / F.max("d")).alias("step"))
        before, l = l, written(l.drop("dl").join(back, same("source", "s")).select("source", "target", "l", F.col("step").alias("dl")), "dual")  # noqa: E741
        dropped(before, each)
        # the dual at several shares of the step: what the exponentials sum to, on straight lines beyond the cap
        steep = F.log(cap / F.col("base")) / F.col("x")

        def summed(t: float) -> Column:
            at = F.col("l") + F.col("m") + t * (F.col("dl") + F.col("dm"))
            return exact_sum(F.col("n") * F.when(at < steep, F.col("base") * F.exp(F.least(at * F.col("x"), F.lit(700.0)))).otherwise(cap + cap * F.col("x") * (at - steep)))

        curved = placed(dm).agg(*[summed(t).alias(f"t{k}") for k, t in enumerate(SHARES)]).first()
        line = l.agg(exact_sum(F.col("l") * F.col("target")).alias("a"), exact_sum(F.col("dl") * F.col("target")).alias("b")).first()
        values = [curved[k] - line.a - t * line.b - sum((v + t * d) * u for (_, u, v), d in zip(m, dm, strict=True)) for k, t in enumerate(SHARES)]
        t = SHARES[min(range(len(SHARES)), key=lambda k: values[k])]
        before, l = l, written(l.select("source", "target", (F.col("l") + t * F.col("dl")).alias("l"), F.lit(0.0).alias("dl")), "dual")  # noqa: E741
        dropped(before)
        m = [(g, u, v + t * d) for (g, u, v), d in zip(m, dm, strict=True)]
    raise RuntimeError("the multipliers did not settle: no rates within the cap may meet the targets")


def rounded(docs: DataFrame, cap: int = 2) -> DataFrame:
    """docs: id, source, size, rate, chunk. Adds copies (whole, 0 to cap)."""
    chunk = Window.partitionBy("source", "chunk")
    order = chunk.orderBy("size", "id", "uid")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    part = docs.withColumn("part", F.col("rate") - F.floor("rate")).withColumn("run", F.sum("part").over(upto))
    before = F.coalesce(F.lag("run").over(order), F.lit(0.0))
    first = part.withColumn("copies", (F.floor("rate") + F.floor(F.col("run") + 0.5) - F.floor(before + 0.5)).cast("long"))
    first = first.withColumn("copies", F.least("copies", F.lit(cap).cast("long")))
    lack = first.withColumn("lack", F.sum(F.col("size") * (F.col("rate") - F.col("copies"))).over(chunk))
    more, less = (F.col("lack") > 0) & (F.col("copies") < cap), (F.col("lack") < 0) & (F.col("copies") > 0)
    run = lack.withColumn("moved", F.sum(F.when(more | less, F.col("size")).otherwise(F.lit(0))).over(upto))
    fits = F.col("moved") <= F.abs("lack")
    return run.withColumn("copies", F.when(more & fits, F.col("copies") + 1).when(less & fits, F.col("copies") - 1).otherwise(F.col("copies")))


def dealt(rated: DataFrame, chunk_rows: int = 2000) -> DataFrame:
    """rated: id, uid, n_docs (of the source). Adds chunk, by the id's hash; rows whose id is null or repeated are spread by uid."""
    again = rated.where("id is not null").groupBy(F.col("id").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again")
    named = rated.where("id is not null").join(again, F.col("id") == F.col("again"), "left").withColumn("spread", F.when(F.col("again").isNotNull(), F.col("uid"))).drop("again")
    rows = named.unionByName(rated.where("id is null").withColumn("spread", F.col("uid")))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("id", "spread"), F.ceil(F.col("n_docs") / chunk_rows))).drop("spread")  # a null changes no hash


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", base: Column | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, cap: int = 2, chunk_rows: int = 2000, row_col: str | None = None) -> DataFrame:
    """docs: any columns; base: the base rate of a document (above 0; 1 if not given). Returns id, uid (a number of the row: row_col, or one of its own), source, size, source_size, target, rate, copies.

    Null texts and texts without a word have size 0 and take nothing (the tilt leaves them their base rate). Null sources are one source, the last. Null ids are
    dealt like any other. Repeated rows are documents of their own. An empty table gives no rows."""
    q = F.lit(1.0) if base is None else base.cast("double")
    sizes = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), q.alias("base"), (F.monotonically_increasing_id() if row_col is None else F.col(row_col)).alias("uid")), "sizes")
    targets = written(source_targets(sizes, weights, share, cap), "targets")
    dual = balanced_rates(sizes, targets, cap, by_size=True)
    of = written(targets.join(dual.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select(F.col("source").alias("of"), "source_size", "n_docs", "target", "multiplier", "scale"), "multipliers")
    dropped(targets)
    rated = sizes.join(of, F.col("source").eqNullSafe(F.col("of"))).withColumn("rate", tilted(F.col("base"), F.col("multiplier"), F.col("size") / F.col("scale"), cap))
    return rounded(dealt(rated, chunk_rows), cap).select("id", "uid", "source", "size", "source_size", "target", "rate", "copies")


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies."""
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")

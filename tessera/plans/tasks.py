"""Strategies by name, and tasks that run them: what a client submits, lists, follows, cancels and reads."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import attention, ecm, matmul, sorting
from ..sources import files
from ..storage import work_dir
from . import tiling


@dataclass(frozen=True)
class Strategy:
    """run(spark, inputs, config) gives the result as a DataFrame; chunks(config) how many chunks the work has, where that is known before; read(spark, files, config) makes inputs of files (path, size) for tasks that name files."""

    id: str
    name: str
    run: Callable[[SparkSession, dict[str, DataFrame], dict], DataFrame]
    chunks: Callable[[dict], int | None] = lambda config: None
    read: Callable[[SparkSession, DataFrame, dict], dict[str, DataFrame]] = lambda spark, found, config: {}


def _matmul(spark, inputs, config):
    a, b = inputs["a"], inputs["b"]
    kind = config.get("datatype", "f64")
    cut = lambda bits: lambda v: numbers.fraction_cut(v.cast("double"), bits)
    as_kind = {"f16": lambda v: numbers.half(v.cast("double")), "bf16": cut(7), "tf32": cut(10), "int8": numbers.signed_byte} | {k: lambda v, t=t: v.cast(t) for k, t in (("f32", "float"), ("f64", "double"), ("i32", "int"), ("i64", "long"))}
    a, b = (x.withColumn("v", as_kind[kind](F.col("v"))) for x in (a, b))
    n, m, k = (config[x] for x in "NMK")
    whole = kind in ("i32", "i64", "int8")
    if kind == "i32":
        return matmul.product(a, b, "long").withColumn("v", numbers.wrapped32(F.col("v")))
    if whole or config.get("form", tiling.form(n, m, k, 1.0)) == "cells":
        return matmul.product(a, b, "long" if whole else "double")
    return matmul.tiled_product(a, b, *tile_shape(config))


def tile_shape(config: dict) -> tuple[int, int, int]:
    """Sizes that the config names, or those of its element budget: (height, width, depth)."""
    if "tile_size" in config or "k_tile_size" in config:
        t = max(1, config.get("tile_size", 256))
        return t, t, min(config["K"], max(1, config.get("k_tile_size", min(config["K"], t))))
    return tiling.tile_sizes(config["N"], config["M"], config["K"], config.get("chunk_size", 8 * 1024 * 1024))


def _matmul_chunks(config):
    rows, cols, depth = tile_shape(config)
    return -(-config["N"] // rows) * -(-config["M"] // cols) * -(-config["K"] // depth)


def _sort(spark, inputs, config):
    x = inputs["sequence"]
    if (n := config.get("max_elements")) is not None:
        x = sorting.first_elements(x, n)
    return sorting.sorted_u32(x, "value", config.get("ascending", True))


def _attention(spark, inputs, config):
    heads, width = config.get("num_heads", 1), config["d_model"]
    q, k, v = (attention.heads(inputs[x], heads, width) for x in "qkv")
    return attention.side_by_side(attention.attended(q, k, v, width // heads))


def _ecm(spark, inputs, config):
    return ecm.curves(spark, ecm.parsed(config["N"]), config.get("B1", 50_000), config.get("total_curves", 1024), config.get("chunk_size", 256), config.get("seed", 1))


def only_file(found: DataFrame) -> str:
    """The path of the one file; none or several are an error."""
    paths = [r.path for r in found.select("path").limit(2).collect()]
    if len(paths) != 1:
        raise ValueError("the task needs one file")
    return paths[0]


def _read_pair(spark, found, config):
    n, m, k = (config[x] for x in "NMK")
    pair = files.picked_pair(found.withColumn("group", F.lit(0)), F.lit(4 * n * k), F.lit(4 * k * m)).first()
    if pair is None:
        raise ValueError("the task needs two files")
    return {"a": files.matrix_file(spark, pair.a, n, k).select("i", F.col("j").alias("k"), "v"), "b": files.matrix_file(spark, pair.b, k, m).select(F.col("i").alias("k"), "j", "v")}


def _read_heads(spark, found, config):
    named = {r.name: r.path for r in files.named_files(found, ["Q.bin", "K.bin", "V.bin"]).collect()}
    if len(named) != 3:
        raise ValueError("the task needs Q.bin, K.bin and V.bin")
    rows = lambda path: files.matrix_file(spark, path, config["seq_len"], config["d_model"]).groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", F.col("v").cast("double").alias("v")))).alias("c")).select("i", F.col("c.v").alias("v"))
    return {x.lower(): rows(named[f"{x}.bin"]) for x in "QKV"}


STRATEGIES = {
    s.id: s
    for s in (
        Strategy("matmul", "Matrix product by cells or tiles", _matmul, _matmul_chunks, _read_pair),
        Strategy("sort-u32", "Global sort of unsigned integers", _sort, lambda c: -(-c["count"] // c.get("chunk_size", 65_536)) if "count" in c else None, lambda spark, found, config: {"sequence": files.u32_file(spark, only_file(found))}),
        Strategy("attention", "Multi-head attention", _attention, lambda c: c.get("num_heads", 1), _read_heads),
        Strategy("ecm-stage1", "Elliptic-curve factoring, stage 1", _ecm, lambda c: ecm.chunk_count(c.get("total_curves", 1024), c.get("chunk_size", 256))),
    )
}


def register(strategy: Strategy) -> None:
    """Makes a strategy known, whose kernel is any function of its inputs; an id that is known already is an error."""
    if strategy.id in STRATEGIES:
        raise ValueError(f"strategy {strategy.id} is known already")
    STRATEGIES[strategy.id] = strategy


def unregister(strategy_id: str) -> None:
    del STRATEGIES[strategy_id]


def strategies(spark: SparkSession) -> DataFrame:
    """What can be submitted: (id, name)."""
    return spark.createDataFrame([(s.id, s.name) for s in STRATEGIES.values()], "id string, name string")


@dataclass
class Task:
    """states: created, running, assembling, completed, error, canceled."""

    strategy: str
    inputs: dict[str, DataFrame]
    config: dict
    label: str = ""
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "created"
    created: float = field(default_factory=time.time)
    started: float | None = None
    ended: float | None = None
    error: str = ""
    output: str = ""

    def descriptor(self) -> str:
        """The task as JSON."""
        s = STRATEGIES[self.strategy]
        return json.dumps({"id": self.id, "label": self.label, "strategy": self.strategy, "config": self.config, "inputs": sorted(self.inputs), "chunks": s.chunks(self.config), "created": self.created}, sort_keys=True)


class Tasks:
    """Submitted tasks of one session. Each runs under a tag of its own, by which it is canceled; its output is a table in the shared folder, complete before the status says so."""

    def __init__(self, spark: SparkSession, parallel: int = 2):
        self.spark, self.pool = spark, ThreadPoolExecutor(parallel)
        self.tasks: dict[str, Task] = {}
        self.runs: dict[str, Future] = {}

    def submit(self, strategy: str, inputs: dict[str, DataFrame], config: dict, label: str = "") -> Task:
        if strategy not in STRATEGIES:
            raise ValueError(f"no strategy {strategy}")
        task = Task(strategy, inputs, config, label)
        self.tasks[task.id] = task
        return task

    def submit_json(self, text: str, folder: str = "") -> Task:
        """A task from JSON: strategyId, label, config, input (arguments, which count as config) and cachedFilePaths, names of files in the folder or paths. Files that aren't there are passed by, as are those whose strategy reads none."""
        given = json.loads(text)
        if not given.get("strategyId"):
            raise ValueError("strategyId is required")
        if given["strategyId"] not in STRATEGIES:
            raise ValueError(f"no strategy {given['strategyId']}")
        config = {**given.get("config", {}), **given.get("input", {})}
        found = []
        for name in given.get("cachedFilePaths", []):
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}" if folder else name)
            fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
            if fs.exists(at):
                found.append((at.toString(), fs.getFileStatus(at).getLen()))
        inputs = STRATEGIES[given["strategyId"]].read(self.spark, self.spark.createDataFrame(found, "path string, size long"), config) if found else {}
        return self.submit(given["strategyId"], inputs, config, given.get("label") or "task")

    def start(self, task: Task) -> Future:
        """Runs the task once; a canceled one isn't started."""
        if task.status != "created":
            raise ValueError(f"the task is {task.status}")
        task.status, task.started = "running", time.time()
        self.runs[task.id] = self.pool.submit(self._run, task)
        return self.runs[task.id]

    def _run(self, task: Task) -> None:
        self.spark.addTag(f"task-{task.id}")
        try:
            result = STRATEGIES[task.strategy].run(self.spark, task.inputs, task.config)
            if task.status == "canceled":
                return
            task.status, path = "assembling", f"{work_dir(self.spark)}/task-{task.id}"
            result.write.parquet(path)
            if task.status != "canceled":
                task.output, task.status = path, "completed"
        except Exception as e:
            if task.status != "canceled":
                task.error, task.status = str(e)[:2000], "error"
        finally:
            task.ended = time.time()
            self.spark.removeTag(f"task-{task.id}")

    def cancel(self, task: Task) -> None:
        if task.status in ("created", "running", "assembling"):
            task.status = "canceled"
            self.spark.interruptTag(f"task-{task.id}")

    def output(self, task: Task) -> DataFrame:
        if task.status != "completed":
            raise ValueError(f"the task is {task.status}")
        return self.spark.read.parquet(task.output)

    def listing(self) -> DataFrame:
        """(id, label, strategy, status, created, started, ended, duration_ms, error), the newest first."""
        rows = [(t.id, t.label, t.strategy, t.status, t.created, t.started, t.ended, None if t.ended is None or t.started is None else int((t.ended - t.started) * 1000), t.error) for t in self.tasks.values()]
        return self.spark.createDataFrame(rows, "id string, label string, strategy string, status string, created double, started double, ended double, duration_ms long, error string").orderBy(F.desc("created"))

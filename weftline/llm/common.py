"""Helpers shared by the operators: paths, exact positions, ordered cuts, components."""

from __future__ import annotations

import gc
import hashlib
import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch that goes to a Python worker: rows are whole texts, and 10,000 of them can be much.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes too, unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one for local tests if that is unset."""
    bound_batches(spark)
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.gettempdir()}/weftline-checkpoints"
    return where.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a table in the shared folder and returns what was written, without df's lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{spark._jvm.java.util.UUID.randomUUID()}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes tables that cut has written and no plan needs any more, and the shuffle files of plans that are gone."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.cut_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    release(frames[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete shuffle files that no live plan needs any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """A column name like name that df doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_hashes(text: str) -> tuple[Column, Column]:
    """128 bits of hash of a text column, null as empty."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.xxhash64(whole), F.xxhash64(F.lit(1), whole)


def only_rows(docs: DataFrame, kept: DataFrame, key: str, text: str) -> DataFrame:
    """One row of docs for each (own, h1, h2) of kept: a key, null ones too, and the text's hashes. Texts are shuffled once."""
    names = [fresh(docs, x) for x in ("own_row__", "own_h1__", "own_h2__")]
    rows = docs.withColumns(dict(zip(names, (F.xxhash64(F.col(key)), *text_hashes(text)), strict=True)))
    wanted = kept.select(F.xxhash64("own").alias(names[0]), F.col("h1").alias(names[1]), F.col("h2").alias(names[2]))
    return rows.join(wanted, names, "left_semi").dropDuplicates(names).drop(*names)


_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a polynomial hash's odd base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        both = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        _powers[:] = both
    return _powers[0], _powers[1]


class Shipped:
    """A file's bytes, read on the driver and broadcast, so that workers need no such file: tokenizers of some megabytes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        bound_batches(spark)
        data = Path(path).read_bytes()
        if len(data) > MOST_SHIPPED:
            raise ValueError(f"{path} is over {MOST_SHIPPED} bytes")
        self.mark, self.data = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)


#: Bytes of a file that is broadcast, at most.
MOST_SHIPPED = 64 << 20


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def small_batches(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about `most` bytes of column; a longer text has a slice of its own."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = pc.cumulative_sum(pc.add(pc.fill_null(pc.binary_length(batch.column(column)), 0), 1).cast(pa.int64())).to_numpy()
        start = 0
        while start < len(ends):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(ends.searchsorted(base + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop


#: Rows in the broadcast table of bucket offsets, at most.
MOST_BUCKETS = 1 << 17


def position(df: DataFrame, out: str, key: Column, key_bits: int, ties: list[Column], groups: list[str] = (), n_groups: int = 1, bits: int = 16, counts_of: DataFrame | None = None) -> DataFrame:
    """Adds out: each row's rank, gapless from 0, in the order of key (a non-negative long of key_bits bits) within its group.

    No task sees a whole group: the high bits of key cut it into 2**bits buckets, whose counts give every bucket's
    first rank. Only those counts are broadcast, if they are MOST_BUCKETS rows at most; beyond that they are joined by a
    shuffle. counts_of: the same rows with fewer columns, from which the counts can be had more cheaply.
    """
    b, first, n = (fresh(df, x) for x in ("bucket__", "first__", "n__"))
    bucket = F.shiftright(key, key_bits - bits)
    counts = (counts_of if counts_of is not None else df).groupBy(*groups, bucket.alias(b)).agg(F.count(F.lit(1)).alias(n))
    running = Window.partitionBy(*groups).orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select(*groups, b, (F.sum(n).over(running) - F.col(n)).alias(first))
    within = Window.partitionBy(*groups, b).orderBy(key, *ties)
    joined = df.withColumn(b, bucket).join(F.broadcast(offsets) if n_groups << bits <= MOST_BUCKETS else offsets, [*groups, b])
    return joined.withColumn(out, F.col(first) + F.row_number().over(within) - F.lit(1)).drop(b, first)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): (node, root), where root is the component's smallest node.

    Labels spread by min over neighbours and jump to the label of the label, so that a path of length n takes about
    log n rounds. Each round is two joins of written tables (which adaptive execution can split at a hot node) and one
    aggregation with partial sums; nothing is collected but a count of the labels that changed.
    """
    both = cut(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    table_ = labels
    for _ in range(most_rounds):
        seen = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = cut(labels.join(seen, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root")))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = cut(step.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")))
        changed = new.where("root <> was").limit(1).count()
        discard(table_, step)
        table_, labels = new, new.select("node", "root")
        if not changed:
            discard(both)
            labels.cut_path = new.cut_path
            return labels
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

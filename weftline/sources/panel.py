"""Panels: one row per series with its history and future as arrays, built from long tables, records or closed forms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..plans.state import kernel


def finite(y: Column) -> Column:
    """y with NaN and infinities as null."""
    return F.when(~F.isnan(y) & (F.abs(y) < F.lit(float("inf"))), y)


def grid(long: DataFrame, length: int, horizon: int) -> DataFrame:
    """(series_id, ord, history, future) of long rows (series_id, t, y): one value for each t from 0, null where there is none.

    The future is cleaned like a loader's records (linear, flat at its ends); the history keeps its gaps.
    """
    size = length + horizon
    cells = F.array_sort(F.collect_list(F.struct("t", finite(F.col("y")).alias("y"))))
    wide = long.where(F.col("t").between(0, size - 1)).groupBy("series_id").agg(cells.alias("cells"))
    blank = lambda a, z: F.when(z > a, F.array_repeat(F.lit(None).cast("double"), z - a)).otherwise(F.array().cast("array<double>"))
    gaps = F.transform("cells", lambda c, i: F.concat(blank(F.when(i == 0, F.lit(0)).otherwise(F.get("cells", i - 1)["t"] + 1), c["t"]), F.array(c["y"])))
    full = F.concat(F.flatten(gaps), blank(F.element_at("cells", -1)["t"] + 1, F.lit(size)))
    dense = wide.select("series_id", full.alias("y"))
    arrays = dense.select("series_id", F.slice("y", 1, length).alias("history"), F.slice("y", length + 1, horizon).alias("future"))
    return with_order(kernel(arrays, lambda y: (K.linear_fill(y),), ["future"], {"future": "array<double>"}))


def with_order(panel: DataFrame) -> DataFrame:
    """ord: the rank of series_id, which stands for row order; counted by ranges of ids, not in one task.

    Series are range-partitioned, numbered within their range, and the ranges' counts, a row for each, give the offsets.
    """
    ranged = panel.repartitionByRange("series_id").sortWithinPartitions("series_id").withColumn("part__", F.spark_partition_id())
    least = ranged.groupBy("part__").agg(F.min("series_id").alias("lo"), F.max("series_id").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    bounds, before = [], 0
    for r in sorted(least, key=lambda r: (r["lo"] is not None, r["lo"])):
        bounds.append((r["hi"], before))
        before += r["n"]
    if len(bounds) <= 1:
        return panel.withColumn("ord", (F.row_number().over(Window.orderBy("series_id")) - 1).cast("int")) if before <= 100_000 else _ranked(panel, bounds)
    return _ranked(panel, bounds)


def _ranked(panel: DataFrame, bounds: list[tuple[object, int]]) -> DataFrame:
    """Ranks by the ranges with the given last ids and first ranks."""
    where = F.lit(len(bounds) - 1)
    for i in range(len(bounds) - 2, -1, -1):
        where = F.when(F.col("series_id") <= F.lit(bounds[i][0]), F.lit(i)).otherwise(where)
    firsts = F.array(*[F.lit(b) for _, b in bounds])
    out = panel.withColumn("part__", where)
    within = Window.partitionBy("part__").orderBy("series_id")
    return out.withColumn("ord", (F.get(firsts, F.col("part__")) + F.row_number().over(within) - 1).cast("int")).drop("part__")


def assert_rectangular(panel: DataFrame) -> tuple[int, int]:
    """The one length of all histories and of all futures; ValueError if there are more."""
    r = panel.agg(*[f(F.size(c)).alias(f"{n}_{c}") for c in ("history", "future") for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if r["lo_history"] is None or r["lo_history"] != r["hi_history"] or r["lo_future"] != r["hi_future"]:
        raise ValueError("all series of a panel need one length of history and one of future")
    return r["lo_history"], r["lo_future"]


def to_long(panel: DataFrame, column: str = "history") -> DataFrame:
    return panel.select("series_id", "ord", F.posexplode(column).alias("t", "y"))


def events_hourly(spark: SparkSession, sf_dir: str, length: int = 672, horizon: int = 48) -> DataFrame:
    """Sum of value by hour since 2024-01-01 for each event type."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01 00:00:00', ts)").cast("int")
    long = events.groupBy(F.col("event_type").alias("series_id"), hour.alias("t")).agg(F.round(F.sum("value"), 6).alias("y"))
    return grid(long, length, horizon)


def users_daily(spark: SparkSession, sf_dir: str, length: int = 24, horizon: int = 6) -> DataFrame:
    """Sum of value by day since 2024-01-01 for each user."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "value")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    long = events.groupBy(F.col("user_id").alias("series_id"), day.alias("t")).agg(F.round(F.sum("value"), 6).alias("y"))
    return grid(long, length, horizon)


def orders_monthly(spark: SparkSession, sf_dir: str, length: int = 68, horizon: int = 12) -> DataFrame:
    """Count of orders by month since 1995-01 for each priority; a month without any counts 0."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderdate")
    month = (F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate") - 1
    long = orders.groupBy(F.col("o_orderpriority").alias("series_id"), month.cast("int").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    panel = grid(long, length, horizon)
    zero = lambda c: F.transform(c, lambda y: F.coalesce(y, F.lit(0.0)))
    return panel.withColumn("history", zero("history"))


def sliding_windows(series: DataFrame, history_len: int, horizon: int, stride: int = 1, max_windows: int | None = None) -> DataFrame:
    """(series_id, window_start, window_end, history, future) of every window of an array column `y`; short series have none."""
    size = history_len + horizon
    last = F.size("y") - F.lit(size)
    starts = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(max(stride, 1))))
    if max_windows is not None:
        starts = F.slice(starts, 1, max_windows)
    out = series.select("series_id", "y", F.explode(starts).alias("window_start"))
    return out.select("series_id", "window_start", (F.col("window_start") + size).alias("window_end"), F.slice("y", F.col("window_start") + 1, F.lit(history_len)).alias("history"), F.slice("y", F.col("window_start") + history_len + 1, F.lit(horizon)).alias("future"))


def record_series(records: DataFrame, mode: str = "history_plus_future") -> DataFrame:
    """records (history, future) with y, as mode says."""
    if mode not in ("history_only", "future_only", "history_plus_future"):
        raise ValueError(f"unknown mode {mode}")
    y = {"history_only": F.col("history"), "future_only": F.col("future"), "history_plus_future": F.concat("history", "future")}[mode]
    return records.withColumn("y", y)


def manifest(frame: DataFrame, tag_contains: str, max_records: int | None = None) -> DataFrame:
    """Rows whose tag holds a text, in any case and taken literally; ValueError if none does."""
    out = frame.where(F.lower("tag").contains(tag_contains.lower()))
    if not out.limit(1).count():
        raise ValueError(f"no tag holds {tag_contains!r}")
    return out if max_records is None else out.orderBy("tag").limit(max_records)


def read_records(spark: SparkSession, manifest_path: str, tag_contains: str, max_records: int | None = None) -> DataFrame:
    """Parquet shards that a CSV manifest (tag, path) lists, with their tags; shards that are missing or can't be read are skipped.

    Whether a shard can be read shows in the tasks that read it, so Spark is told to pass over broken files there.
    """
    rows = manifest(spark.read.csv(manifest_path, header=True), tag_contains).orderBy("tag").collect()
    reader = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    frames = []
    for r in rows:
        try:
            frames.append(reader.parquet(r["path"]).withColumn("tag", F.lit(r["tag"])))
        except Exception as e:  # noqa: BLE001  no path, or not one footer to take the schema from
            print(f"skipped {r['path']}: {type(e).__name__}")
    if not frames:
        raise ValueError("no shard can be read")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out if max_records is None else out.limit(max_records)


def datasets(records: DataFrame, max_series: int | None = None, seed: int = 0) -> dict[str, DataFrame]:
    """Panels of records (history, future, source_domain, source_subset, item_id), by the name `domain__subset`.

    Records are grouped by subset, and a group's panel has those of its most frequent lengths. Only names are collected;
    each panel is a filter of one frame, whose series are numbered by item_id and chunk.
    """
    named = records.withColumn("dataset", F.concat_ws("__", F.coalesce("source_domain", F.lit("unknown")), F.coalesce("source_subset", F.lit("unknown"))))
    named = named.withColumn("series_id", F.concat_ws("@", F.col("item_id").cast("string"), F.col("chunk_start").cast("string")) if "chunk_start" in records.columns else F.col("item_id").cast("string"))
    kept = mode_lengths(named, ["dataset"], max_series, seed)
    names = [r["dataset"] for r in kept.select("dataset").distinct().orderBy("dataset").collect()]
    return {n: with_order(kept.where(F.col("dataset") == n).select("series_id", F.transform("history", finite).alias("history"), "future")) for n in names}


def manual(spark: SparkSession, series: dict[str, list[float]], horizon: int) -> DataFrame:
    """A panel of given series, whose last `horizon` values are the future; all of one length."""
    if len({len(y) for y in series.values()}) > 1 or any(len(y) <= horizon for y in series.values()):
        raise ValueError("series need one length, longer than the horizon")
    rows = [(name, i, [None if v is None else float(v) for v in y[:-horizon]], [float(v) for v in y[-horizon:]]) for i, (name, y) in enumerate(sorted(series.items()))]
    panel = spark.createDataFrame(rows, "series_id string, ord int, history array<double>, future array<double>")
    return panel.withColumn("history", F.transform("history", finite))


def record_windows(records: DataFrame, history_len: int, horizon: int, stride: int = 1, max_windows: int | None = None, order: list[str] = ("tag", "item_id"), mode: str = "history_plus_future") -> DataFrame:
    """Windows over all records, in the order of records and starts, up to max_windows over all: a top-k, not a cut of each record."""
    rows = record_series(records, mode).withColumn("series_id", F.concat_ws("/", *[F.col(c).cast("string") for c in order]))
    out = sliding_windows(rows, history_len, horizon, stride)
    return out if max_windows is None else out.orderBy("series_id", "window_start").limit(max_windows)


def of_lengths(records: DataFrame, length: int, horizon: int) -> DataFrame:
    return records.where((F.size("history") == length) & (F.size("future") == horizon))


def mode_lengths(records: DataFrame, by: list[str] = (), max_series: int | None = None, seed: int = 0) -> DataFrame:
    """Records of each group's most frequent pair of lengths (the longest of equals), of two series or more; all groups at once."""
    lengths = records.withColumns({"n_history": F.size("history"), "n_future": F.size("future")})
    counts = lengths.groupBy(*by, "n_history", "n_future").count()
    best = Window.partitionBy(*by).orderBy(F.col("count").desc(), F.col("n_history").desc(), F.col("n_future").desc())
    kept = counts.withColumn("k", F.row_number().over(best)).where("k = 1 and count >= 2 and n_history >= 2 and n_future >= 1").select(*by, "n_history", "n_future")
    out = lengths.join(F.broadcast(kept), [*by, "n_history", "n_future"], "left_semi").drop("n_history", "n_future")
    if max_series is not None:
        order = Window.partitionBy(*by).orderBy(F.xxhash64(F.lit(seed), "series_id"), "series_id")
        out = out.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_series).drop("k")
    return out


def synthetic(spark: SparkSession, series: int = 5, length: int = 72, horizon: int = 24, period: int = 24, base: float = 8.0, step: float = 0.5, amplitude: float = 2.0, noise: float = 0.0, seed: int = 0) -> DataFrame:
    """base + step * k + amplitude * sin(2 pi t / period) for series k, with noise in the history only."""
    turn = 2 * math.pi / period

    def wave(a: int, n: int, noisy: bool) -> Column:
        clean = lambda t: F.lit(base) + F.lit(step) * F.col("ord") + F.lit(amplitude) * F.sin(t.cast("double") * F.lit(turn))
        u = lambda t, k: (F.pmod(F.xxhash64(F.lit(seed + k), "ord", t), F.lit(1 << 40)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 40))
        draw = lambda t: F.lit(noise) * F.sqrt(F.lit(-2.0) * F.log(u(t, 1))) * F.cos(F.lit(2 * math.pi) * u(t, 2))
        return F.transform(F.sequence(F.lit(a), F.lit(a + n - 1)), lambda t: clean(t) + draw(t) if noisy and noise else clean(t))

    ids = spark.range(series).select(F.format_string("s%05d", "id").alias("series_id"), F.col("id").cast("int").alias("ord"))
    return ids.select("series_id", "ord", wave(0, length, True).alias("history"), wave(length, horizon, False).alias("future"))

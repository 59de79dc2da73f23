"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a mean repetition rate; a document's hash, read as a uniform number, is inverted through the Poisson
distribution of that mean to its count of copies; copies then take their places in the order of another hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, position

#: Sources with their distributions are broadcast up to this many; beyond it, Spark joins by shuffling.
BROADCAST_SOURCES = 5_000
MOST_RATE = 500.0


def _hex(prefix: str, seed: int, digits: int, *columns: Column) -> Column:
    """The first hex digits of an MD5 over prefix, seed and columns, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(prefix), F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])), 1, digits), 16, 10).cast("long")


def uniform(seed: int, *columns: Column) -> Column:
    """A hash of the columns in [0, 1), of 52 bits."""
    return _hex("u", seed, 13, *columns).cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, source: str = "source", weights: dict[str | None, float] | None = None, alpha: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """(source, n, rate): mean copies of each source's documents, so that shares become the target weights.

    weights: target shares (of those sources, None for documents without; others have none). Without it, the share of a
    source of n documents is in proportion to n ** alpha. epochs: rows of the mixture per input row. No rows, no rates.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    else:
        chosen = F.create_map(*[F.lit(x) for k, v in weights.items() if k is not None for x in (k, float(v))]) if set(weights) - {None} else None
        named = F.lit(0.0) if chosen is None else F.coalesce(F.element_at(chosen, F.col("source").cast("string")), F.lit(0.0))
        counts = counts.withColumn("w", F.when(F.col("source").isNull(), F.lit(float(weights.get(None, 0.0)))).otherwise(named))
    total = counts.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    if not total["n"] or not total["w"]:
        return counts.select("source", "n", F.lit(0.0).alias("rate"))
    return counts.select("source", "n", (F.col("w") / F.lit(float(total["w"])) * F.lit(epochs * total["n"]) / F.col("n").cast("double")).alias("rate"))


def poisson_cdf(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... up to where the rest is below any 52-bit uniform number's step."""
    last = F.ceil(rate + F.lit(12.0) * F.sqrt(rate) + F.lit(40.0)).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k.cast("double")
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["all"])


def poisson_mix(docs: DataFrame, rates: DataFrame, key: str = "doc_id", source: str = "source", seed: int = 17, text: str = "text") -> DataFrame:
    """docs with n_copies, copy (from 1) and position (gapless from 0 over the whole mixture): a row for each copy.

    A document of rate r has k copies with the Poisson probability of k at mean r; none, and it has no row. Rows of one
    key have the same count; rows without one go by their texts' hashes, if docs has that column. Null sources are a
    source of their own. Columns of docs with those names are replaced; all others are carried, texts of any length. An
    empty table stays empty. A mean of over MOST_RATE copies is refused (ValueError).
    """
    docs = docs.drop("n_copies", "copy", "position")
    top = rates.agg(F.max("rate").alias("r"), F.count(F.lit(1)).alias("n")).first()
    if top["r"] is not None and (top["r"] > MOST_RATE or not math.isfinite(top["r"])):
        raise ValueError(f"a mean of {top['r']:.4g} copies is over {MOST_RATE:.4g}")
    s, cdf = fresh(docs, "source__"), fresh(docs, "cdf__")
    small = rates.where("rate > 0").select(F.col("source").alias(s), poisson_cdf(F.col("rate")).alias(cdf))
    if top["n"] <= BROADCAST_SOURCES:
        small = F.broadcast(small)

    with_text = text in docs.columns and text != key
    identity = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))) if with_text else F.col(key)

    def copies(rows: DataFrame) -> DataFrame:
        u = uniform(seed, identity)
        counted = rows.join(small, rows[source].eqNullSafe(F.col(s))).withColumn("n_copies", F.size(F.filter(F.col(cdf), lambda c: c <= u))).drop(s, cdf)
        return counted.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))

    place = _hex("p", seed, 15, identity, F.col("copy"))
    return position(copies(docs), "position", place, 60, [F.col(key), F.col("copy")], counts_of=copies(docs.select(*dict.fromkeys([key, source, *([text] if with_text else [])]))))

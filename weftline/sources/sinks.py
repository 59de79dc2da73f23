"""Writing results, and ranking records of a corpus index."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Sweep results as Parquet by dataset; ranking is a matter of reading (sweep.ranked)."""
    results.write.mode(mode).partitionBy("dataset").parquet(path)


def write_ranked(frames: list[DataFrame], path: str) -> None:
    """One ranked CSV of several sweeps' results: by mase, missing ones last."""
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    rows.orderBy(F.col("mase").asc_nulls_last(), "dataset", "sequence").coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_csv(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("header", True).csv(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Results CSV: quoted fields, empty mase as null."""
    return spark.read.csv(path, header=True, quote='"', escape='"', schema="dataset string, length int, mase double, rmse double, mae double, seconds double, status string, sequence string")


def boxed_html(sequences: list[str], title: str = "Sequences") -> str:
    rows = "".join("<p>" + " &rarr; ".join(f"<code>{html.escape(t)}</code>" for t in s.split(" -> ")) + "</p>" for s in sequences)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title>{rows}"


def slug(text: Column) -> Column:
    """Lower-case letters and digits, with one dash for all between."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def rank_records(found: DataFrame, hints: list[str], least: int = 1, top: int = 50) -> DataFrame:
    """(ref, slug, queries, votes, relevance) of search hits (ref, query): one row per ref, those most relevant first.

    relevance: how many of the hints the ref holds, in any case. votes: its hits. queries: all that found it, in order.
    """
    each = found.groupBy("ref").agg(F.concat_ws(" ", F.array_sort(F.collect_set("query"))).alias("queries"), F.count(F.lit(1)).alias("votes"))
    relevance = sum((F.lower("ref").contains(h.lower()).cast("int") for h in hints), F.lit(0))
    rows = each.select("ref", slug(F.col("ref")).alias("slug"), "queries", "votes", relevance.alias("relevance")).where(F.col("relevance") >= least)
    return rows.orderBy(F.col("relevance").desc(), F.col("votes").desc(), "ref").limit(top)

"""Sharding by jump consistent hashing, in DataFrame functions only.

A key walks a short chain of pseudo-random jumps; its last stop below the shard count is its shard. There is no ring
table, and with one more shard a key either stays or moves into the new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from .common import MOST_BUCKETS, position

#: Multiplier of the published jump hash's linear congruential generator.
MULTIPLIER = 2862933555777941757
M32 = (1 << 32) - 1


def _times(x: Column, c: int) -> Column:
    """x * c mod 2**32 for 0 <= x < 2**32, without overflow of a signed long."""
    return (x * F.lit(c & 0xFFFF) + F.shiftleft((x * F.lit(c >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(M32))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a long key. Exact: the chain has at most `shards` jumps, about ln(shards) on average."""
    if not 1 <= shards <= 1 << 24:
        raise ValueError("shards must be from 1 to 2**24")
    low, high = MULTIPLIER & M32, MULTIPLIER >> 32
    one = lambda x: F.lit(x).cast("long")

    def step(s: Column, _: Column) -> Column:
        p1 = s["lo"] * F.lit(low >> 16)
        u = s["lo"] * F.lit(low & 0xFFFF) + F.shiftleft(p1.bitwiseAND(F.lit(0xFFFF)), 16) + F.lit(1)
        hi = (F.shiftright(p1, 16) + F.shiftright(u, 32) + _times(s["hi"], low) + _times(s["lo"], high)).bitwiseAND(F.lit(M32))
        leap = F.floor((s["j"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / (F.shiftright(hi, 1) + F.lit(1)).cast("double"))).cast("long")
        moved = F.struct(hi.alias("hi"), u.bitwiseAND(F.lit(M32)).alias("lo"), s["j"].alias("b"), leap.alias("j"))
        return F.when(s["j"] < F.lit(shards), moved).otherwise(s)

    def walk(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)

    start = F.struct(F.shiftrightunsigned(key, 32).alias("hi"), key.bitwiseAND(F.lit(M32)).alias("lo"), one(-1).alias("b"), one(0).alias("j"))
    short = min(shards, 40)
    done = walk(start, short)
    if short < shards:  # rows whose chain is longer than that are next to none, and walk the whole of it
        done = F.when(done["j"] >= F.lit(shards), done).otherwise(walk(start, shards))
    return done["b"].cast("int")


def key_of(column: str) -> Column:
    """A well-mixed long of a key column of any type; null has a value of its own."""
    return F.xxhash64(F.col(column))


def assign_shards(df: DataFrame, key: str, shards: int, bits: int = 8) -> DataFrame:
    """df with law ('key'), shard, slot and grown_shard (the shard if there were one more).

    The key and the shard count alone decide the shard, of at most 2**24. slot numbers a shard's rows gaplessly from 0, by
    a hash of the key and all other plain columns, so that rows of one key are spread over tasks too; equal rows take
    neighbouring slots in any order. Columns of df with those names are replaced. Null keys share one shard, as rows of
    one key do; an empty table stays empty. Only narrow counts are shuffled twice; rows are shuffled once, by (shard,
    hash prefix), never a whole shard to one task.
    """
    df = df.drop("law", "shard", "slot", "grown_shard")
    h = key_of(key)
    out = df.withColumns({"law": F.lit("key"), "shard": jump_hash(h, shards), "grown_shard": jump_hash(h, shards + 1)})
    plain = [f.name for f in df.schema.fields if f.name != key and isinstance(f.dataType, AtomicType)]
    order = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(1), *[F.col(c) for c in plain]), 1)
    while bits and shards << bits > MOST_BUCKETS:
        bits -= 1
    return position(out, "slot", order, 63, [F.col(key)], ["shard"], shards, bits, counts_of=out.select(key, "shard", *plain))


def write_shards(df: DataFrame, key: str, shards: int, path: str) -> None:
    """Writes df's rows as Parquet, one folder per shard, sorted by slot within a file."""
    assign_shards(df, key, shards).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)

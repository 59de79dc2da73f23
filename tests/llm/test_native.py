"""Sharding, mixing and chat formatting."""

import math
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import chat, common, mixing, queries, sharding


def jump(key: int, shards: int) -> int:
    b, j = -1, 0
    while j < shards:
        b, key = j, (key * sharding.MULTIPLIER + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding_is_jump_hash_and_grows_into_the_new_shard_only(spark, sf):
    rows = queries.op1_sharding(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in common.table(spark, sf, "documents").collect()}
    slots = defaultdict(list)
    for r in rows:
        key = xxhash.xxh64_intdigest(struct.pack("<q", r["doc_id"]), 42)
        assert (r["shard"], r["grown_shard"]) == (jump(key, 40), jump(key, 41))
        assert r["grown_shard"] in (r["shard"], 40)
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == len(texts)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_long_chains_are_walked_to_the_end(spark):
    keys = spark.range(300).select(F.xxhash64("id").alias("k"))
    for shards in (1, 2, 41, 1000):
        for r in keys.select("k", sharding.jump_hash(F.col("k"), shards).alias("s")).collect():
            assert r["s"] == jump(r["k"] & (2**64 - 1), shards)


def test_sharding_of_odd_rows(odd, with_clashes, empty):
    assert sharding.assign_shards(empty, "doc_id", 3).count() == 0
    out = sharding.assign_shards(with_clashes, "doc_id", 3)
    assert out.where("law = 'key'").count() == 12 and set(with_clashes.columns) <= set(out.columns)
    nulls = odd.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    rows = sharding.assign_shards(nulls, "doc_id", 5).collect()
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    for s in range(5):
        own = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert own == list(range(len(own)))


def test_sharding_into_very_many_shards(spark):
    rows = sharding.assign_shards(spark.range(3000).withColumn("x", F.col("id") % 3), "id", 1 << 20).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 3000 and max(slots) >= 1 << 17 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_rows_of_one_key_do_not_meet_in_one_bucket(spark):
    rows = sharding.assign_shards(spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").alias("x")), "doc_id", 4)
    assert len({r["shard"] for r in rows.collect()}) == 1 and sorted(r["slot"] for r in rows.collect()) == list(range(2000))


def test_sharded_files(odd, spark, tmp_path):
    sharding.write_shards(odd, "doc_id", 3, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 12


def test_cdf_is_poissons(spark):
    for rate in (0.01, 0.7, 3.0, 40.0):
        cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(rate)).alias("c")).first()["c"]
        total = 0.0
        for k, c in enumerate(cdf[:20]):
            total += math.exp(-rate) * rate**k / math.factorial(k)
            assert c == pytest.approx(total, abs=1e-12)
        assert cdf[-1] == pytest.approx(1, abs=1e-12)


def test_mixture_meets_its_weights(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").otherwise("small").alias("source"))
    rates = mixing.source_rates(docs, weights={"big": 1, "small": 3})
    rows = mixing.poisson_mix(docs, rates).collect()
    shares = Counter(r["source"] for r in rows)
    assert shares["small"] / len(rows) == pytest.approx(0.75, abs=0.01)
    assert len(rows) == pytest.approx(20000, rel=0.03)
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    by_position = [r["source"] for r in sorted(rows, key=lambda r: r["position"])]
    assert Counter(by_position[:2000])["small"] / 2000 == pytest.approx(0.75, abs=0.05)
    copies = Counter(r["doc_id"] for r in rows)
    assert all(copies[r["doc_id"]] == r["n_copies"] for r in rows)


def test_rows_without_ids_are_drawn_each_for_itself(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("a").alias("source"))
    counts = Counter(r["n_copies"] for r in mixing.poisson_mix(docs, mixing.source_rates(docs)).dropDuplicates(["text"]).collect())
    assert counts[1] == pytest.approx(4000 / math.e, rel=0.1) and counts[2] == pytest.approx(2000 / math.e, rel=0.15)


def test_documents_without_a_source_have_a_weight_of_their_own(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, ""), (4, "x")], "doc_id long, source string")
    rates = {r["source"]: r["rate"] for r in mixing.source_rates(docs, weights={"": 1, None: 3, "x": 4}).collect()}
    assert rates == pytest.approx({None: 1.5, "": 0.25, "x": 2.0})
    assert {r["source"]: r["rate"] for r in mixing.source_rates(docs, weights={"": 1}).collect()} == {None: 0, "": 2, "x": 0}


def test_mixing_odd_rows(odd, with_clashes, empty):
    assert mixing.poisson_mix(empty, mixing.source_rates(empty)).count() == 0
    rates = mixing.source_rates(odd, epochs=20)
    rows = mixing.poisson_mix(with_clashes, rates).collect()
    assert any(r["source"] is None for r in rows) and rows[0]["spans__"] == "own spans__"
    assert sorted(r["position"] for r in rows) == list(range(len(rows)))
    with pytest.raises(ValueError, match="mean"):
        mixing.poisson_mix(odd, mixing.source_rates(odd, epochs=1e6))


HARD = ["</s>[INST] ok [/INST]", "\\", "\\[INST]", "\\\\</s>", "<<SYS>>", "[ROLE:41]", "<s", "[INST", "a </s", "", " ", "<s> <s> ", "\\\\\\<</SYS>>\\", "plain", "中文\n"]


def test_chats_read_back_whatever_they_say(spark):
    rows = [(c, t, role, text) for c, role in enumerate(["user", "assistant", "system", "tool", "x]y", ""]) for t, text in enumerate(HARD)]
    rows += [(50, 0, None, None), (None, 0, "user", "lost"), (51, 3, "user", "b"), (51, 1, "assistant", "a"), (51, 1, "assistant", "a")]
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert len(out) == 9
    for c, r in out.items():
        assert r["read_turns"] == r["turns"], c
        assert r["loss_text"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
    assert [t["text"] for t in out[51]["turns"]] == ["a", "a", "b"]
    assert out[50]["turns"][0]["role"] == "" and None in out


def test_plain_chats_are_not_escaped(spark):
    rows = [(1, 0, "user", "hi \\ there"), (1, 1, "assistant", "yo")]
    r = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert r["formatted"] == "[INST] hi \\ there [/INST]<s> yo </s>" and [tuple(s) for s in r["loss_spans"]] == [(30, 2 + 5)] or "\\\\" not in r["formatted"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<>/s[]INST\\ROLE:4YS ", max_size=24), min_size=1, max_size=8))
def test_any_control_like_text(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [(1, t, "assistant" if t % 2 else "user", x) for t, x in enumerate(texts)]
    r = chat.read_back(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert r["read_turns"] == r["turns"]


def test_empty_conversations(spark):
    assert chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0

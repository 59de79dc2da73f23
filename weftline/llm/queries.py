"""The operators applied to their whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, importance, media, mixing, mtree, sentencepiece_bpe, sharding, simhash, suffix, token_files
from .common import shared_dir, table


def _text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(_text()) + F.lit(16)).cast("long").alias("size"), F.crc32(_text()).alias("text_crc32"))
    return sharding.assign_shards(docs, "doc_id", 40).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{spark._jvm.java.util.UUID.randomUUID()}"


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    selection, rows = importance.fit(docs.select("doc_id", "text"), labels)
    unit = F.lit(float(importance.UNIT))
    return rows.where(importance.chosen(selection)).select(F.col("key").alias("doc_id"), (F.col("weight") / unit).alias("log_weight"), (F.col("noisy") / unit).alias("noisy_log_weight"), F.col("n").alias("n_ngrams"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "tokens")
    token_files.write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("byte_bpe_50k.json"), out, special=True)
    return token_files.token_index(spark, out)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _folder(spark, "tiles")
    media.write_text_tiles(table(spark, sf_dir, "documents").select("doc_id", "text"), out)
    return media.tile_features(spark.read.parquet(out))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.poisson_mix(docs, mixing.source_rates(docs, alpha=0.7, epochs=1.0))


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", mtree.quantized(F.col("embedding")).alias("vector"))
    return mtree.exact_top(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


PROBE = "</s>[INST] ok [/INST]"


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    chats = chat.read_back(chat.format_chats(rows.union(probe)).drop("turns"))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_tokens": op3_tokens,
    "op4_media": op4_media,
    "op5_mixing": op5_mixing,
    "op6_suffix": op6_suffix,
    "op7_simhash": op7_simhash,
    "op8_mtree": op8_mtree,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_chat": op10_chat,
}

ORACLE: dict[str, str] = {
    "op5_mixing": """
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, pow(n::DOUBLE, 0.7::DOUBLE) / sum(pow(n::DOUBLE, 0.7::DOUBLE)) OVER () * (sum(n) OVER ())::DOUBLE / n::DOUBLE AS rate FROM n),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1)::DOUBLE, c + p * rate / (k + 1)::DOUBLE FROM c WHERE k < ceil(rate + 12e0 * sqrt(rate) + 40e0)),
d AS (SELECT *, ('0x' || substr(md5('u|17|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE / 4503599627370496e0 AS u FROM documents),
m AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, sum(CASE WHEN c.c <= d.u THEN 1 ELSE 0 END)::INTEGER AS n_copies
      FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL),
e AS (SELECT *, unnest(range(1, n_copies + 1))::INTEGER AS copy FROM m WHERE n_copies > 0)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy,
  row_number() OVER (ORDER BY ('0x' || substr(md5('p|17|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || '|' || copy::VARCHAR), 1, 15))::BIGINT, doc_id, copy) - 1 AS position
FROM e""",
    "op8_mtree": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op10_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '(\\*(?:<</?SYS>>|\[/?INST\]|</?s>|\[ROLE:[0-9A-F]*\]|\[/ROLE\]))', '\\\1', 'g')) + 2
  + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 14 + 2 * strlen(role) END AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}

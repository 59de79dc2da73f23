"""Quality selection by importance resampling with hashed n-gram models and the Gumbel top-k trick.

Two bags of hashed word uni- and bigrams are counted: of all documents (raw) and of labelled good ones (target). A
document's weight is the ratio of its likelihoods under the two models; adding Gumbel noise to the log weights and
taking the k largest draws k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, discard, fresh, powers, small_batches

U = np.uint64
#: Hash buckets of n-grams.
BUCKETS = 1 << 14
#: Labelled rows that the target model is fitted on, at most: those of the smallest hashes of their ids.
MOST_LABELLED = 20_000
#: Fixed point of log ratios: sums are whole numbers, and so the same in any order.
UNIT = 1 << 20
#: A longer text is hashed in pieces of about so many bytes.
PIECE = 1 << 20
SPACES = b" \t\n\v\f\r"

_CLASS = np.full(256, 2, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def cuts(text: bytes, most: int) -> Iterator[tuple[int, int, bool]]:
    """(start, stop, whether the first word is the last one of the piece before) of pieces of a text, cut at white space.

    A piece begins with the last word of the piece before, so that no pair of words is lost.
    """
    start, stop, carried = 0, 0, False
    while len(text) - stop > most:
        after = max(text.rfind(c, stop + 1, stop + most) for c in SPACES)
        if after < 0:  # one word is longer than a piece
            after = min((at for c in SPACES if (at := text.find(c, stop + 1)) >= 0), default=len(text))
        yield start, after, carried
        stop = after
        piece = np.frombuffer(text, np.uint8, stop - start, start)
        end = len(text[start:stop].rstrip(SPACES))
        carried = end > 0
        differ = np.flatnonzero(_CLASS[piece[:end]] != _CLASS[piece[end - 1]]) if end else []
        start = start + (int(differ[-1]) + 1 if len(differ) else 0) if end else stop
    if stop < len(text) or not text:
        yield start, len(text), carried


def pieces(texts: list[bytes], most: int = PIECE) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(texts' indices, pieces, whether each begins with a word that has been counted) in groups of about `most` bytes."""
    which, group, carried, size = [], [], [], 0
    for i, text in enumerate(texts):
        for start, stop, known in cuts(text, most):
            if size + stop - start > most and group:
                yield np.array(which), group, np.array(carried)
                which, group, carried, size = [], [], [], 0
            which.append(i)
            group.append(text[start:stop])
            carried.append(known)
            size += stop - start
    if group:
        yield np.array(which), group, np.array(carried)


def ngrams(which: np.ndarray, group: list[bytes], carried: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(text's index, bucket) of every uni- and bigram: runs of letters and digits, or of other marks, in lower case."""
    data = np.frombuffer(b"\n".join(group) + b"\n", np.uint8)
    kind = _CLASS[data]
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1])))
    starts, stops = edge, np.concatenate((edge[1:], [len(data)]))
    words = kind[edge] != 0
    starts, stops = starts[words], stops[words]
    up, down = powers(max(len(data) + 1, PIECE * 2 + 2))
    prefix = np.zeros(len(data) + 1, U)
    np.cumsum((_LOWER[data].astype(U) + U(1)) * up[: len(data)], out=prefix[1:])
    h = _mix((prefix[stops] - prefix[starts]) * down[starts])
    ends = np.cumsum([len(x) + 1 for x in group])
    piece = np.searchsorted(ends, starts, "right")
    both = np.flatnonzero(piece[1:] == piece[:-1])
    pair = _mix(h[both] * U(0x9FB21C651E98DF25) + h[both + 1])
    owner = which[piece]
    new = ~(carried[piece] & np.concatenate(([True], piece[1:] != piece[:-1])))[: len(piece)]
    return np.concatenate((owner[new], owner[both])), (np.concatenate((h[new], pair)) >> U(20)).astype(np.int64) % buckets


def counts(docs: DataFrame, good: DataFrame, key: str, text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """n-grams by bucket of all documents (buckets), and of good ones by the fold, 0 or 1, that good has for their keys (2, buckets)."""
    marked = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).join(F.broadcast(good.select(F.col(key).alias("key"), "fold")), "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros((2, buckets), np.int64)
        for batch in small_batches(batches, "text"):
            fold = np.array([-1 if x is None else x for x in batch.column("fold").to_pylist()])
            for which, group, carried in pieces(as_bytes(batch.column("text"))):
                owner, bucket = ngrams(which, group, carried, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                for f in (0, 1):
                    target[f] += np.bincount(bucket[fold[owner] == f], minlength=buckets)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, raw[some], target[0][some], target[1][some])], ["bucket", "raw", "t0", "t1"])

    rows = marked.mapInArrow(run, "bucket long, raw long, t0 long, t1 long").groupBy("bucket").agg(*[F.sum(c).alias(c) for c in ("raw", "t0", "t1")])
    raw, target = np.zeros(buckets, np.int64), np.zeros((2, buckets), np.int64)
    for r in rows.collect():  # one row for each bucket
        raw[r["bucket"]], target[:, r["bucket"]] = r["raw"], (r["t0"], r["t1"])
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log(target / raw) probabilities by bucket, in units of 1 / UNIT."""
    t = np.log((target + smooth) / (target.sum() + smooth * len(target)))
    r = np.log((raw + smooth) / (raw.sum() + smooth * len(raw)))
    return np.round((t - r) * UNIT).astype(np.int64)


def log_weights(texts: list[bytes], ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of ratios, count of n-grams) of each text; a row of sums for each row of ratios, if it has rows."""
    tables = np.atleast_2d(ratios)
    total, n = np.zeros((len(tables), len(texts)), np.int64), np.zeros(len(texts), np.int64)
    for which, group, carried in pieces(texts):
        owner, bucket = ngrams(which, group, carried, tables.shape[1])
        order = np.argsort(owner, kind="stable")
        owner, bucket = owner[order], bucket[order]
        if len(owner):
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            for k, table in enumerate(tables):
                total[k][owner[first]] += np.add.reduceat(table[bucket], first)
            n[owner[first]] += np.diff(np.concatenate((first, [len(owner)])))
    return (total[0] if ratios.ndim == 1 else total), n


def _own_hash(seed: int, key: str, text: str) -> Column:
    """A hash of a row's key, or of its text if it has none."""
    return F.xxhash64(F.lit(seed), F.col(key), F.when(F.col(key).isNull(), F.col(text)))


def gumbel(h: Column) -> Column:
    """Gumbel noise from a hash, in units of 1 / UNIT."""
    u = (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.round(-F.log(-F.log(u)) * F.lit(float(UNIT))).cast("long")


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096) -> tuple[int, int]:
    """(the k-th largest value of a long column, how many rows are larger), by histograms of ever narrower ranges."""
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    lo, hi, above = ends["lo"], ends["hi"], 0
    while lo < hi:
        width = (hi - lo) // bins + 1
        own = rows.where(F.col(column).between(lo, hi)).groupBy(F.expr(f"({column} - {lo}L) div {width}L").alias("bin")).count()
        for r in sorted(own.collect(), key=lambda r: -r["bin"]):  # at most `bins` rows
            if above + r["count"] >= k:
                break
            above += r["count"]
        lo, hi = lo + r["bin"] * width, min(hi, lo + (r["bin"] + 1) * width - 1)
    return lo, above


class Selection:
    """The fitted models, and which noisy weights are among the k largest."""

    def __init__(self, ratios: np.ndarray, least: int, least_tie: int, seed: int) -> None:
        self.ratios, self.least, self.least_tie, self.seed = ratios, least, least_tie, seed


def scored(docs: DataFrame, ratios: np.ndarray, key: str, text: str, seed: int) -> DataFrame:
    """(key, tie, weight, noisy, n, w0, w1): log weights plain and with noise, counts of n-grams, and weights without a fold.

    Weights are in units of 1 / UNIT. ratios: a row for the whole target, and for it without fold 0 and without fold 1.
    tie, a second hash, orders rows of equal noisy weight. Null texts are empty, and have no n-grams.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), gumbel(_own_hash(seed, key, text)).alias("noise"), _own_hash(seed + 1, key, text).alias("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            w, n = log_weights(as_bytes(batch.column("text")), ratios)
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("tie"), *(pa.array(x) for x in (w[0], w[0] + batch.column("noise").to_numpy(), n, w[1], w[2]))], ["key", "tie", "weight", "noisy", "n", "w0", "w1"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, tie long, weight long, noisy long, n long, w0 long, w1 long")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, most_labelled: int = MOST_LABELLED, recall: float = 0.99, slack: float = 8.0, seed: int = 23) -> tuple[Selection, DataFrame]:
    """The selection, and (key, tie, weight, noisy, n) of every document as written to the shared folder.

    labels: (key, quality, toxic); the target is quality 1 that isn't toxic, by most_labelled rows at most. The sample's
    size k is the number of documents that weigh at least what `recall` of the labelled good ones weigh, less `slack`
    (the reach of the noise). For that, a labelled document is weighed by a model without its half of the labels, as its
    own n-grams would speak for it. Documents without any n-gram have no evidence and aren't drawn. Without good labels, or
    without documents that could be drawn, nothing is.
    """
    good = cut(labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").alias(key)).where(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(most_labelled).withColumn("fold", F.xxhash64(key).bitwiseAND(F.lit(1)).cast("int")))
    raw, target = counts(docs, good, key, text, buckets)
    ratios = log_ratios(raw, target.sum(0))
    others = [log_ratios(raw, t) if t.sum() else ratios for t in target[::-1]]
    rows = cut(scored(docs, np.stack([ratios, *others]), key, text, seed))
    rows_with = rows.where("n > 0")
    own = cut(rows_with.join(F.broadcast(good.select(F.col(key).alias("key"), "fold")), "key").select(F.when(F.col("fold") == 0, F.col("w0")).otherwise(F.col("w1")).alias("weight")))
    n_good = own.count()
    nothing = Selection(ratios, (1 << 62), 0, seed)
    if not n_good:
        discard(good, own)
        return nothing, rows
    floor = kth_largest(own, "weight", max(1, math.ceil(recall * n_good)))[0] - round(slack * UNIT)
    discard(good, own)
    k = rows_with.where(F.col("weight") >= floor).count()
    least, above = kth_largest(rows_with, "noisy", k)
    ties = rows_with.where(F.col("noisy") == F.lit(least)).select("tie")
    return Selection(ratios, least, kth_largest(ties, "tie", k - above)[0], seed), rows


def chosen(chosen_by: Selection) -> Column:
    """Whether a scored row is among the k; rows that tie on the last place go by their second hash, repeated rows together."""
    tie = F.col("tie") >= F.lit(chosen_by.least_tie)
    return (F.col("n") > 0) & ((F.col("noisy") > F.lit(chosen_by.least)) | ((F.col("noisy") == F.lit(chosen_by.least)) & tie))


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **how: float) -> DataFrame:
    """The chosen rows of docs, all columns as they are; weights are computed anew rather than joined, so no text is shuffled.

    Keys are of any type that can be hashed; rows without one go by their texts. Repeated rows are drawn together, of
    rows that share a key each by its own text's weight. Null, empty and other texts without any n-gram aren't drawn,
    long ones are weighed whole. An empty table, or one without good labels, gives no rows.
    """
    selection, scores = fit(docs, labels, key, text, **how)
    discard(scores)
    noise, tie = fresh(docs, "noise__"), fresh(docs, "tie__")
    rows = docs.withColumns({noise: gumbel(_own_hash(selection.seed, key, text)), tie: _own_hash(selection.seed + 1, key, text)})
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            w, n = log_weights(as_bytes(batch.column(text)), selection.ratios)
            noisy = w + batch.column(noise).to_numpy()
            last = (noisy == selection.least) & (batch.column(tie).to_numpy() >= selection.least_tie)
            keep = (n > 0) & ((noisy > selection.least) | last)
            yield batch.filter(pa.array(keep)).select(names)

    return rows.mapInArrow(run, docs.schema)

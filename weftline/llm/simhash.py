"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints link if they differ in at most 2r bits. Then some word lies within r bits of both, so every
fingerprint's ball of radius r, its variants, is enumerated; fingerprints that share a variant are a candidate pair,
and the pair is verified. Variants are dealt out by their low bits, a few at a time: a fingerprint is sent once to each
bucket that holds variants of it, and the bucket's task makes those. A bucket with too many fingerprints is dealt out by
the variants' next bits, so that no family of fingerprints meets in one task; with all bits dealt, a bucket is one
variant. So the shuffle carries a few rows for a fingerprint rather than its whole ball, and the work is linear in it.

similar_texts looks for texts whose shingles have a Jaccard similarity of a given percentage. One fingerprint of 64 bits
can't tell those at 4 bits; it takes several shorter ones, of independent hashes: of TABLES fingerprints of TABLE_BITS
bits, a pair of similarity 0.8 has one or more within 2 * RADIUS bits with probability 0.99 (0.9997 at 0.85). Pairs are
verified by their texts' shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, components, cut, discard, only_rows, powers, small_batches, text_hashes

U = np.uint64
BITS, RADIUS, SHINGLE, SEED = 64, 2, 4, 42
#: Of similar_texts: words of a shingle, similarity in percent, fingerprints of a text, their bits.
WORDS, PERCENT, TABLES, TABLE_BITS = 5, 80, 16, 40
#: Variants that a task makes at once, bits that variants are dealt out by at a time, and fingerprints that a bucket takes.
AT_ONCE, STEP, MOST_PRINTS = 1_000_000, 4, 500_000
#: Bytes whose words are hashed at once.
CHUNK = 1 << 20
#: Tasks that the pairs of one text are verified in.
SALTS = 64
#: Links of a fingerprint in a bucket beyond which it is of a cloud; texts and shingles of a group of a cloud.
DENSE, GROUP, GROUP_SHINGLES = 16, 1000, 1_000_000
#: Shingles of a group that the order of a cloud's prefixes knows as frequent.
MOST_FREQUENT = 1 << 16

_WIDE = TABLES * TABLE_BITS // 64
_MASKS, _FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, _WIDE), U) * U(2) + U(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def votes(words: np.ndarray) -> np.ndarray:
    """In how many rows of k 64-bit words each of their 64 * k bits is set. Eight bytes at a time count 255 rows."""
    n, k = words.shape
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(n, 8 * k), axis=1, bitorder="little").view(np.uint64)
    sums = np.add.reduceat(bits, np.arange(0, n, 255), axis=0)
    return sums.view(np.uint8).reshape(len(sums), 64 * k).sum(0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of a text's word shingles: a bit is 1 if it is set in over half the shingles' XXH64. No words: 0."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(line)
    counts, m = np.zeros(BITS, np.int64), n - shingle + 1
    stops = (ends[shingle - 1 :] - 1).tolist()
    for i in range(0, m, 4096):
        h = np.array([digest(view[s:e], seed) for s, e in zip(starts[i : i + 4096], stops[i : i + 4096], strict=True)], U)
        counts += votes(h[:, None])
    return int(np.packbits(counts * 2 > m, bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fingerprint long): null texts count as empty and have fingerprint 0, like any text without words."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            made = np.array([fingerprint(x, shingle, seed) for x in as_bytes(batch.column("text"))], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made)], ["key", "fingerprint"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, fingerprint long").withColumnRenamed("key", key)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(SEED + 1).integers(0, 1 << 63, 256, U)
_BYTES[65:91] = _BYTES[97:123]  # letters A to Z as a to z


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word, of a text whose words are cut by ASCII white space; long texts go in chunks of whole words."""
    out, start = [], 0
    while start < len(text):
        stop = len(text)
        if stop - start > CHUNK:
            stop = max(text.rfind(c, start, start + CHUNK) for c in b" \t\n\v\f\r") + 1
            if not stop:  # one word is longer than a chunk
                stop = min((at for c in b" \t\n\v\f\r" if (at := text.find(c, start)) >= 0), default=len(text) - 1) + 1
        data = np.frombuffer(text, np.uint8, stop - start, start)
        edges = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[data], [True])).view(np.int8)))
        begin, end = edges[::2], edges[1::2]
        up, down = powers(max(len(data), CHUNK) + 1)
        prefix = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTES[data] * up[: len(data)], out=prefix[1:])
        out.append(_mix((prefix[end] - prefix[begin]) * down[begin] + (end - begin).astype(U)))
        start = stop
    return np.concatenate(out) if out else np.zeros(0, U)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct hashes, in order, of a text's word shingles; one of the whole line for a text of fewer words, none of no words."""
    each = word_hashes(text)
    if not len(each):
        return each
    k = min(words, len(each))
    h = np.full(len(each) - k + 1, k, U)
    for i in range(k):
        h = _mix(h * U(0x9FB21C651E98DF25) + each[i : len(each) - k + 1 + i])
    return np.unique(h)


def table_prints(made: np.ndarray) -> np.ndarray:
    """TABLES fingerprints of TABLE_BITS bits of a set of shingle hashes; 0 for an empty one."""
    counts = np.zeros(64 * _WIDE, np.int64)
    for i in range(0, len(made), 4080):
        counts += votes(_mix((made[i : i + 4080, None] ^ _MASKS) * _FACTORS))
    bits = np.zeros((TABLES, 64), np.uint8)
    bits[:, :TABLE_BITS] = (counts * 2 > len(made)).reshape(TABLES, TABLE_BITS)
    return np.packbits(bits, axis=1, bitorder="little").view(U).ravel()


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets in order have a Jaccard similarity of percent at least; empty ones are equal."""
    both = np.sort(np.concatenate((a, b)), kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return common * 100 >= percent * (len(both) - common)


def _signed_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(bits: range, most: int) -> list[int]:
    return [sum(1 << b for b in chosen) for n in range(most + 1) for chosen in combinations(bits, n)]


@lru_cache(maxsize=64)
def _tables(low: int, bits: int, radius: int) -> list[np.ndarray]:
    """By the radius that the low bits have used: what can be flipped of the others."""
    return [np.array(_flips(range(low, bits), radius - t), U) for t in range(radius + 1)]


def _shared(prints: np.ndarray, bucket: int, low: int, bits: int, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (index, index of the smallest fingerprint) of those that share a variant whose low bits are bucket, verified."""
    away = np.bitwise_count((prints ^ U(bucket)) & U((1 << low) - 1))
    prints_at = [np.flatnonzero(away == t) for t in range(radius + 1)]
    tables = _tables(low, bits, radius)
    if sum(len(p) * len(t) for p, t in zip(prints_at, tables, strict=True)) > AT_ONCE and low < bits:
        step = min(STEP, bits - low)
        for more in range(1 << step):
            value = bucket | more << low
            own = np.flatnonzero(np.bitwise_count((prints ^ U(value)) & U((1 << (low + step)) - 1)) <= radius)
            if len(own) > 1:
                for a, b in _shared(prints[own], value, low + step, bits, radius):
                    yield own[a], own[b]
        return
    index_bits = U(max(1, len(prints).bit_length()))
    clear = U(((1 << bits) - 1) ^ ((1 << low) - 1))
    tagged = []
    for at, table in zip(prints_at, tables, strict=True):
        if len(at):
            words = (prints[at, None] & clear) ^ table[None, :]
            mixed = words * U(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> U(29))) * U(0xBF58476D1CE4E5B9)
            mixed = (mixed & ~((U(1) << index_bits) - U(1))) | at.astype(U)[:, None]
            tagged.append(mixed.ravel())
    if not tagged:
        return
    tagged = np.sort(np.concatenate(tagged))
    word = tagged >> index_bits  # a hash of the variant, of 40 bits or more
    again = np.flatnonzero(word[1:] == word[:-1])
    if not len(again):
        return
    who = (tagged & ((U(1) << index_bits) - U(1))).astype(np.int64)
    starts = again[np.concatenate(([True], np.diff(again) > 1))]
    stops = again[np.concatenate((np.diff(again) > 1, [True]))] + 2
    size = stops - starts
    first = np.repeat(who[starts], size)
    members = who[np.repeat(starts - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())]
    near = np.bitwise_count(prints[first] ^ prints[members]) <= 2 * radius
    bad = {int(r) for r in np.repeat(np.arange(len(size)), size)[~near]}
    own = near & (first != members)
    yield members[own], first[own]
    for r in bad:  # the hash has brought two variants together: those of the run that are near
        run = np.unique(who[starts[r] : stops[r]])
        for i, j in combinations(run.tolist(), 2):
            if int(prints[i] ^ prints[j]).bit_count() <= 2 * radius:
                yield np.array([j]), np.array([i])


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of the component of each of n, of edges (a, b)."""
    labels = np.arange(n)
    while True:
        least, before = np.minimum(labels[a], labels[b]), labels.copy()
        np.minimum.at(labels, a, least)
        np.minimum.at(labels, b, least)
        labels = labels[labels]
        if (labels == before).all():
            return labels


def bucket_links(prints: np.ndarray, bucket: int, low: int, bits: int = BITS, radius: int = RADIUS, forest: bool = True, dense: int | None = None) -> list[tuple[int, int, int]]:
    """(fingerprint, smaller fingerprint, how often they shared a variant) through the variants whose low bits are bucket.

    All fingerprints that share a variant are within 2 * radius of each other, so a star from the smallest of them
    stands for all their pairs. forest: only as many links as keep what is connected connected. dense: links of
    fingerprints that have more links than this are given as a star from the smallest fingerprint that they connect,
    0 times, so that there are dense / 2 + 1 links for each fingerprint at most.
    """
    prints = np.unique(np.asarray(prints, U))
    n = len(prints)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    found: dict[int, int] = {}
    for a, b in _shared(prints, bucket, low, bits, radius):
        pairs, times = np.unique(np.maximum(a, b) * n + np.minimum(a, b), return_counts=True)
        for pair, t in zip(pairs.tolist(), times.tolist(), strict=True):
            if forest:
                i, j = root(pair // n), root(pair % n)
                if i == j:
                    continue
                parent[max(i, j)] = min(i, j)
            found[pair] = found.get(pair, 0) + t
    if dense is not None and found:
        both = np.array(list(found), np.int64)
        a, b = both // n, both % n
        links = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
        many = (links[a] > dense) | (links[b] > dense)
        first = _smallest(n, a[many], b[many])
        found = {pair: found[pair] for pair in both[~many].tolist()} | {i * n + int(first[i]): 0 for i in np.flatnonzero(first != np.arange(n)).tolist()}
    return [(int(prints[pair // n]), int(prints[pair % n]), t) for pair, t in found.items()]


def _links_of(low: int, bits: int, radius: int, forest: bool, dense: int | None) -> Callable[[tuple, pa.Table], pa.Table]:
    def run(group: tuple, rows: pa.Table) -> pa.Table:
        tag, bucket = (x.as_py() for x in group)
        found = bucket_links(rows.column("fingerprint").to_numpy().view(U), bucket & ((1 << low) - 1), low, bits, radius, forest, dense)
        made = np.array([x[:2] for x in found], U).reshape(-1, 2).view(np.int64)
        return pa.table({"tag": pa.array([tag] * len(made), pa.int64()), "a": made[:, 0], "b": made[:, 1], "times": pa.array([x[2] for x in found], pa.int64())})

    return run


def near_links(prints: DataFrame, bits: int = BITS, radius: int = RADIUS, forest: bool = True, most: int = MOST_PRINTS, dense: int | None = None) -> DataFrame:
    """(tag, a, b, times): links between distinct fingerprints (columns tag and fingerprint) of one tag, as bucket_links has them.

    With forest every component stays whole; without, each two that share a variant are linked with the smallest that
    does, or beyond dense links of one fingerprint in a bucket are connected, 0 times.
    """
    level = prints.select("tag", "fingerprint").distinct().withColumn("bucket", F.lit(0).cast("long"))
    low, links, used = 0, [], []
    while True:
        step = min(STEP, bits - low)
        wide = low + step
        values = F.array(*[F.lit(_signed_long(v << low)).cast("long") for v in range(1 << step)])
        dealt = F.explode(F.transform(values, lambda v: F.col("bucket").bitwiseOR(v))).alias("bucket")
        mask = F.lit(_signed_long((1 << wide) - 1)).cast("long")
        near = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("bucket")).bitwiseAND(mask)) <= radius
        sent = level.select("tag", "fingerprint", dealt).where(near)
        last = wide >= bits
        cold = sent
        if not last:
            alike = level.groupBy("tag", "bucket", F.col("fingerprint").bitwiseAND(mask).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))
            full = cut(alike.select("tag", "n", "fingerprint", dealt).where(near).groupBy("tag", "bucket").agg(F.sum("n").alias("n")).where(F.col("n") > most).select("tag", "bucket"))
            used.append(full)
            last = not full.limit(1).count()
            cold = sent if last else sent.join(full, ["tag", "bucket"], "left_anti")

        links.append(cold.groupBy("tag", "bucket").applyInArrow(_links_of(wide, bits, radius, forest, dense), "tag long, a long, b long, times long"))
        if last:
            break
        level, low = cut(sent.join(full, ["tag", "bucket"], "left_semi")), wide
        used.append(level)
    out = cut(reduce(DataFrame.union, links))
    if used:
        discard(*used)
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint long, component_id): documents whose fingerprints link, directly or through others, share it.

    component_id is the smallest key of the component; fingerprints link at 2 * radius or fewer differing bits. Copies
    are gathered into one fingerprint before anything is compared, so a group of copies costs one row for each task
    that holds some. Texts that are null, empty or without words link with each other (fingerprint 0). A repeated row
    is its own copy; a null key is its own smallest only if it has no other. Long texts count whole. Empty tables give
    no rows, and no column of docs but key and text is looked at.
    """
    prints = cut(fingerprints(docs, key, text, shingle, seed).withColumnRenamed(key, "key"))
    links = near_links(prints.select(F.lit(0).cast("long").alias("tag"), "fingerprint"), BITS, radius)
    roots = components(links)
    firsts = prints.groupBy("fingerprint").agg(F.min("key").alias("first"))
    rooted = cut(firsts.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = cut(rooted.join(smallest, "root").select("fingerprint", "component_id"))
    discard(links, rooted, roots)
    return prints.join(classes, "fingerprint").select(F.col("key").alias(key), "fingerprint", "component_id")


def _signed(rows: DataFrame) -> DataFrame:
    """rows (own, h1, h2, text) with the size of the text's shingle set and its fingerprints in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            sets = [shingle_set(x) for x in as_bytes(batch.column("text"))]
            prints = np.concatenate([table_prints(s) for s in sets]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * TABLES), pa.array(prints))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("own", "h1", "h2")), pa.array([len(s) for s in sets], pa.int64()), lists], ["own", "h1", "h2", "size", "prints"])

    return rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, h1 long, h2 long, size long, prints array<long>")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose texts are similar. Each b brings its text; a's comes once to each task that has some of its pairs."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    one = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    others = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "text")
    rows = one.union(others).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, U)
        for batch in small_batches(batches, "text"):
            found: list[tuple[int, int]] = []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), as_bytes(batch.column("text")), strict=True):
                made = shingle_set(text)
                if b is None:
                    own = made
                elif similar(own, made, percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return rows.select("a", "b", "text").mapInArrow(run, "a long, b long")


def _gathered(stars: DataFrame, passes: int = 2) -> DataFrame:
    """(a, b): links that connect what stars (a, its centre b) connect, one for each a and some among centres.

    A text has a centre in each bucket of each table, and texts of a cloud have many of them in common. So each list of
    centres is linked with its smallest, and what that says of the others is the same for many texts. A list is as long
    as there are tables and buckets, however many texts a cloud has.
    """
    out, used = [], []
    for _ in range(passes):
        lists = cut(stars.groupBy("a").agg(F.collect_set("b").alias("centres")).withColumn("b", F.array_min("centres")))
        out.append(lists.select("a", "b"))
        stars = lists.select(F.explode("centres").alias("a"), "b").where("a <> b").distinct()
        used.append(lists)
    gathered = cut(reduce(DataFrame.union, [*out, stars]))
    discard(*used)
    return gathered


def _near(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which two of some sets are similar, as a matrix; all pairs are compared."""
    m, sizes = len(sets), np.array([len(x) for x in sets], np.float32)
    both = np.zeros((m, m), np.float32)  # whole numbers under 2 ** 24
    all_, owner = np.concatenate([np.zeros(0, U), *sets]), np.repeat(np.arange(m), sizes.astype(np.int64))
    order = np.argsort(all_, kind="stable")
    all_, owner = all_[order], owner[order]
    _, column, n = np.unique(all_, return_inverse=True, return_counts=True)
    rare = n <= 8
    for k in range(1, 8):  # owners of one element are in order
        same = np.flatnonzero((column[k:] == column[:-k]) & rare[column[k:]])
        np.add.at(both, (owner[same], owner[same + k]), 1)
    both += both.T
    column, owner, wide = (np.cumsum(~rare) - 1)[column[~rare[column]]], owner[~rare[column]], 4096
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + wide, wide))
    for i, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        has = np.zeros((m, wide), np.float32)
        has[owner[a:z], column[a:z] - i * wide] = 1
        both += has @ has.T
    return both * 100 >= percent * (sizes[:, None] + sizes[None, :] - both)


def similar_sets(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """The smallest index of the component of each of some sets, of those that are similar."""
    return _smallest(len(sets), *np.nonzero(np.triu(_near(sets, percent), 1)))


def _sets(rows: pa.Table) -> list[np.ndarray]:
    return [shingle_set(x) for x in as_bytes(rows.column("text"))]


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (cloud, node, size, ...) with a group of their cloud, own, and how many it has, groups."""
    n = rows.groupBy("cloud").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(GROUP), F.sum("size") / F.lit(GROUP_SHINGLES))).cast("int").alias("groups"))
    return rows.join(n, "cloud").withColumn("groups", F.greatest("groups", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("groups")).cast("int"))


def _in_groups(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): what is similar in each group of rows (cloud, own, node, text), as stars from the text that most others are similar to."""

    def run(group: pa.Table) -> pa.Table:
        nodes, near = group.column("node").to_numpy(), _near(_sets(group), percent)
        first = _smallest(len(nodes), *np.nonzero(np.triu(near, 1)))
        order = np.lexsort((near.sum(0), first))
        lead = np.zeros(len(nodes), np.int64)
        lead[first[order]] = order  # the last of each that is written
        linked = np.flatnonzero(lead[first] != np.arange(len(nodes)))
        return pa.table({"a": nodes[lead[first[linked]]], "b": nodes[linked]})

    return rows.select("cloud", "own", "node", "text").groupBy("cloud", "own").applyInArrow(run, "a long, b long")


def _frequent(group: pa.Table) -> pa.Table:
    """(cloud, frequent): shingles that two or more texts of a group have, the most frequent last."""
    made, n = np.unique(np.concatenate([np.zeros(0, U), *_sets(group)]), return_counts=True)
    order = np.argsort(n, kind="stable")[-MOST_FREQUENT:]
    return pa.table({"cloud": group.column("cloud").slice(0, 1), "frequent": pa.array([made[order[n[order] > 1]].view(np.int64)], pa.list_(pa.int64()))})


def _prefixes(percent: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(cloud, node, class, token): the first shingles of each text, by one order for all of its cloud, of which similar texts have one in common.

    Of a set of n, percent of n at least are in any similar set, so that the first of these is among n less that, plus
    one. The order has what is frequent last; it decides how many shingles are met by others, not what is found.
    """

    def run(group: pa.Table, order: pa.Table) -> pa.Table:
        frequent = order.column("frequent").combine_chunks().flatten().to_numpy().view(U)
        by_hash = np.argsort(frequent)
        tokens = []
        for made in _sets(group):
            rank = np.full(len(made), -1)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent[by_hash], made), len(frequent) - 1)
                rank = np.where(frequent[by_hash][at] == made, by_hash[at], -1)
            most = len(made) - -(-percent * len(made) // 100) + 1
            tokens.append(made[np.lexsort((made, rank))[:most]] if len(made) else np.zeros(1, U))  # empty sets are similar
        each = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
        return pa.table({**{c: group.column(c).take(pa.array(each)) for c in ("cloud", "node", "class")}, "token": np.concatenate(tokens).view(np.int64)})

    return run


def _cloud_links(clouds: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that connect what is similar among texts of clouds (cloud, node, size).

    A cloud is dealt into groups whose texts are all compared, and then one text of each class found with each other.
    What is left are pairs of texts of different classes. Two such can only be similar if their prefixes have a shingle
    in common; texts for which that holds meet, all of them with all that aren't of the largest class.
    """
    rows = cut(_dealt(clouds).join(texts, "node").select("cloud", "node", "size", "groups", "own", "text"))
    links = cut(_in_groups(rows, percent))
    many = rows.where("groups > 1")
    if not many.limit(1).count():
        discard(rows)
        return links
    leads = _dealt(links.select(F.col("a").alias("node")).distinct().join(many.drop("own", "groups"), "node"))
    between = cut(_in_groups(leads, percent))
    known = links.union(between)
    roots = components(known)
    classed = cut(many.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root"))
    order = many.where("own = 0").groupBy("cloud").applyInArrow(_frequent, "cloud long, frequent array<long>")
    order = many.select("cloud", "own").distinct().join(order, "cloud", "left").withColumn("frequent", F.coalesce("frequent", F.array().cast("array<long>")))
    first = classed.select("cloud", "own", "node", "class", "text").groupBy("cloud", "own").cogroup(order.groupBy("cloud", "own"))
    prefixes = cut(first.applyInArrow(_prefixes(percent), "cloud long, node long, class long, token long"))
    met = prefixes.groupBy("cloud", "token").agg(F.min("class").alias("least"), F.max("class").alias("most")).where("least < most")
    left = cut(prefixes.join(met, ["cloud", "token"], "left_semi").select("node").distinct().join(classed.select("cloud", "node", "size", "class"), "node"))
    largest = left.groupBy("cloud", "class").agg(F.count(F.lit(1)).alias("n")).groupBy("cloud").agg(F.max(F.struct("n", "class")).alias("top")).select("cloud", F.col("top.class").alias("top"))
    sides = left.join(largest, "cloud").withColumn("side", (F.col("class") == F.col("top")).cast("int"))
    count = lambda side: F.ceil(F.greatest(F.sum((F.col("side") == side).cast("int")) / F.lit(GROUP), F.sum(F.when(F.col("side") == side, F.col("size"))) / F.lit(GROUP_SHINGLES))).cast("int")
    sides = sides.join(sides.groupBy("cloud").agg(count(0).alias("rest"), count(1).alias("tops")), "cloud")
    own = F.when(F.col("side") == 0, F.pmod(F.xxhash64("node"), F.col("rest"))).otherwise(F.col("rest") + F.pmod(F.xxhash64("node"), F.col("tops"))).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("rest") - 1 + F.when(F.col("side") == 0, F.col("tops")).otherwise(0)), lambda g: g != F.col("group"))
    blocks = sides.withColumn("group", own).select("cloud", "node", "class", "group", F.explode(others).alias("other"))
    blocks = blocks.select("cloud", "node", "class", F.least("group", "other").alias("i"), F.greatest("group", "other").alias("j"))

    def run(group: pa.Table) -> pa.Table:
        own = group.column("class").to_numpy()
        first = similar_sets(_sets(group), percent)
        least = own.copy()
        np.minimum.at(least, first, own)
        both = np.unique(np.stack([least[first], own]), axis=1)
        return pa.table({c: both[i][both[0] != both[1]] for i, c in enumerate(("a", "b"))})

    crossing = cut(blocks.join(texts, "node").groupBy("cloud", "i", "j").applyInArrow(run, "a long, b long").distinct())
    out = cut(known.union(crossing))
    discard(rows, links, between, roots, classed, prefixes, left, crossing)
    return out


def similar_texts(docs: DataFrame, own: str, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(own, h1, h2, root): texts whose word shingles have a Jaccard similarity of percent at least, directly or through others, share root.

    (h1, h2) is a hash of 128 bits of the text, null as empty; rows are told apart by it and own. Texts without words are
    each other's copies. Every candidate that near_links or an equal fingerprint gives is verified. Where fingerprints
    have many links, candidates would grow with the square of a group of near copies: those texts are a cloud, known by
    links that connect it, and all pairs of a cloud are compared where groups of its texts meet. Empty tables give no rows.
    """
    h1, h2 = text_hashes(text)
    rows = docs.select(F.col(own).alias("own"), h1.alias("h1"), h2.alias("h2"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    signed = cut(_signed(rows))
    nodes = cut(signed.groupBy("h1", "h2").agg(F.first("size").alias("size"), F.first("prints").alias("prints")).withColumn("node", F.monotonically_increasing_id()))
    prints = cut(nodes.select("node", "size", F.posexplode("prints").alias("tag", "fingerprint")).withColumn("tag", F.col("tag").cast("long")))
    leads = cut(prints.groupBy("tag", "fingerprint").agg(F.min(F.struct("node", "size")).alias("lead"), F.count(F.lit(1)).alias("n")))
    lead = lambda name: leads.select("tag", F.col("fingerprint").alias(name), F.col("lead").alias(f"{name}_lead"))
    first = near_links(leads, TABLE_BITS, RADIUS, forest=False, dense=DENSE)
    links = first.join(lead("a"), ["tag", "a"]).join(lead("b"), ["tag", "b"]).select("a_lead", "b_lead", (F.col("times") == 0).alias("dense"))
    stars = first.where("times = 0")
    crowded = stars.select("tag", F.col("a").alias("fingerprint")).union(stars.select("tag", "b")).distinct().withColumn("crowded", F.lit(True))
    alike = prints.join(leads.where("n > 1"), ["tag", "fingerprint"]).where("node <> lead.node").join(crowded, ["tag", "fingerprint"], "left")
    alike = alike.select(F.struct("node", "size").alias("a_lead"), F.col("lead").alias("b_lead"), ((F.col("n") > DENSE) | F.col("crowded").isNotNull()).alias("dense"))
    linked = cut(links.where("a_lead.node <> b_lead.node").union(alike).distinct())
    gathered = _gathered(linked.where("dense").select(F.col("a_lead.node").alias("a"), F.col("b_lead.node").alias("b")))
    clouds = components(gathered)
    fits = F.least("a_lead.size", "b_lead.size") * F.lit(100) >= F.greatest("a_lead.size", "b_lead.size") * F.lit(percent)
    cloud = lambda name: clouds.select(F.col("node").alias(name), F.col("root").alias(f"{name}_cloud"))
    pairs = linked.where("not dense").where(fits).select(F.col("b_lead.node").alias("a"), F.col("a_lead.node").alias("b")).distinct()
    pairs = pairs.join(cloud("a"), "a", "left").join(cloud("b"), "b", "left")
    tried = cut(pairs.where(F.coalesce(F.col("a_cloud") != F.col("b_cloud"), F.lit(True))).select("a", "b"))
    named = tried.select("b").union(tried.select("a")).union(clouds.select("node")).distinct().withColumnRenamed("b", "node").join(nodes.select("node", "h1", "h2"), "node")
    firsts = signed.groupBy("h1", "h2").agg(F.min("own").alias("own"))
    row = named.join(firsts, ["h1", "h2"]).select("h1", "h2", F.xxhash64("own").alias("row"), "node")
    texts = cut(rows.withColumn("row", F.xxhash64("own")).join(row, ["h1", "h2", "row"]).dropDuplicates(["h1", "h2", "row"]).select("node", "text"))
    discard(prints, leads, first, linked, gathered)
    in_clouds = clouds.select("node", F.col("root").alias("cloud")).join(nodes.select("node", "size"), "node")
    found = [cut(_verified(tried, texts, percent)), _cloud_links(in_clouds, texts, percent)]
    discard(clouds, tried)
    roots = components(reduce(DataFrame.union, found))
    classes = nodes.select("h1", "h2", "node").join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"))
    out = cut(signed.select("own", "h1", "h2").join(classes, ["h1", "h2"]))
    discard(signed, nodes, texts, roots, *found)
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """docs without near-duplicates: of each group of similar_texts one row of its smallest key stays (of a null key, if it has no other).

    Rows are told apart by key and text, so of repeated rows one stays, and rows that only share a key, or have none, are
    each their own.
    """
    found = similar_texts(docs, key, text, percent)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "h1", "h2")).alias("first"))
    return only_rows(docs, cut(first.select(F.col("first.own").alias("own"), "first.h1", "first.h2")), key, text)

"""Exact repeated-substring removal with suffix arrays built by induced sorting.

A byte goes if a string of `window` bytes that covers it also starts earlier. Building one suffix array of the whole
corpus isn't possible on many machines, so the corpus is dealt out to shards by what its windows hold:

1. Anchors. Of every window's grams the one with the smallest hash is its anchor; that depends on the window's bytes
   alone, so both copies of a repeated window have their anchor at the same offset. Neighbouring windows mostly share
   one, so there is about one anchor for 35 bytes. An anchor whose gram occurs once holds no repeat.
2. Classes. A context is all windows that chose an anchor. Equal contexts (by two hashes of 64 bits, of gram and context)
   are gathered, with partial sums, before any of their bytes are shuffled: all but the earliest are repeats as a whole.
3. Shards. The earliest contexts of one gram go to one shard. A suffix array of the shard's contexts (induced sorting) and
   its permuted common prefixes give the runs of suffixes that share `window` bytes, of which the earliest stays.
4. A gram with more different contexts than a shard should hold is dealt out further by what they hold beyond it: each
   context is compared with the gram's earliest one, byte by byte. Windows that lie in what both share are repeats;
   those that reach over its right end go to the group of that length and next byte, those that reach over its left end
   likewise. Equal windows do so alike, so they meet again; groups that are small enough by then go to the shards.

Every step is a shuffle by hash, and the work is linear in the bytes of the contexts.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, discard, fresh, powers, release, small_batches

WINDOW, GRAM = 100, 32
#: Bytes in one vector operation, and the bits that hold a position in them.
CHUNK, POSITION_BITS = 1 << 18, 20
#: Different contexts of one gram that a shard takes as they come; grams of more are dealt out further.
SHARD_CONTEXTS = 4096
#: Bytes of contexts in one suffix array, besides the last gram's.
SHARD_BYTES = 1 << 20
#: Rows of one group that are compared with the group's earliest in different tasks.
SALTS = 64
#: Suffixes in the buckets that are filled at a time, besides the last bucket's.
BUCKETS = 8192
#: Bits of a length or offset in packed places and spans.
SMALL = 12

U = np.uint64
_BYTES = np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)], U)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(29))


def segments(texts: list[bytes], window: int = WINDOW) -> Iterator[list[tuple[int, int, bytes]]]:
    """Groups of about CHUNK bytes of (text's index, offset in it, bytes); longer texts are cut so that every window is whole in one piece."""
    group, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text) - window + 1, 0), CHUNK - window + 1):
            piece = text[at : at + CHUNK]
            if size + len(piece) > CHUNK and group:
                yield group
                group, size = [], 0
            group.append((i, at, piece))
            size += len(piece)
    if group:
        yield group


def anchors(group: list[tuple[int, int, bytes]], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of a group of segments, for each anchor: gram and context hash, text's index, the gram's position in it, its offset in the first window that chose it, and the count of those windows."""
    sizes = np.array([len(x[2]) for x in group], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
    n = len(data)
    up, down = powers(CHUNK + 1)
    prefix = np.zeros(n + 1, U)
    np.cumsum(_BYTES[data] * up[:n], out=prefix[1:])
    hashes = _mix((prefix[gram:] - prefix[:-gram]) * down[: n - gram + 1])
    low = U((1 << POSITION_BITS) - 1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=U)
    width, span = window - gram + 1, 1
    while span * 2 <= width:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < width:
        best = np.minimum(best[: n - window + 1], best[width - span :])
    whole = np.repeat(ends - window, sizes)[: n - window + 1] >= np.arange(n - window + 1)
    starts = np.flatnonzero(whole)
    chosen = (best[starts] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
    count = np.diff(np.concatenate((first, [len(chosen)])))
    p, q = starts[first], chosen[first]
    context = (prefix[p + count + window - 1] - prefix[p]) * down[p]
    context = _mix(context ^ ((q - p).astype(U) << U(20)) ^ (count.astype(U) << U(40)))
    which = np.searchsorted(ends, p, "right")
    offsets = np.array([x[1] for x in group], np.int64) - (ends - sizes)
    return hashes[q], context, np.array([x[0] for x in group], np.int64)[which], q + offsets[which], q - p, count


def _induce(s: np.ndarray, smaller: np.ndarray, by_symbol: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix order that the order of leftmost-smaller suffixes lms induces: larger ones from the left, smaller ones from the right.

    A suffix takes its place in its symbol's bucket by the place of the suffix after it. Buckets are filled some at a
    time (symbols a to z - 1): where the suffix after one stands outside them, its place is known, and one sort deals
    all those out; the few others follow one by one, as the scan meets the suffix after them.
    """
    n = len(s)
    sizes = np.bincount(s)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    sa, place = np.empty(n, np.int64), np.full(n + 1, -1)
    symbols = s[lms]
    order = np.argsort(symbols, kind="stable")
    count = np.bincount(symbols, minlength=len(sizes))
    sorted_symbols = symbols[order]
    place[lms[order]] = (stops - np.cumsum(count))[sorted_symbols] + np.arange(len(lms))
    edges = np.unique(np.concatenate(([0], np.searchsorted(stops, np.arange(BUCKETS, n, BUCKETS)) + 1, [len(sizes)])))
    kinds = smaller[by_symbol]
    after = np.append(s[1:], -1)
    for kind, ranges in ((False, zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)), (True, zip(edges[-2::-1].tolist(), edges[:0:-1].tolist(), strict=True))):
        own = by_symbol[kinds == kind]
        own_stops = np.cumsum(np.bincount(s[own], minlength=len(sizes)))
        for a, z in ranges:
            i = own[own_stops[a - 1] if a else 0 : own_stops[z - 1]]
            if not len(i):
                continue
            inner = (after[i] < z) if kind else (after[i] >= a)
            outer = i[~inner]
            outer = outer[np.argsort(s[outer] * (n + 1) + place[outer + 1])]
            count = np.bincount(s[outer] - a, minlength=z - a)
            first = stops[a:z] - count if kind else starts[a:z]
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(outer))
            sa[at], place[outer] = outer, at
            rest = i[inner]
            if len(rest):
                next_ = (first if kind else first + count).tolist()
                waits = set(rest.tolist())
                ready = rest[(smaller[rest + 1] != kind) | ((after[rest + 1] >= z) if kind else (after[rest + 1] < a))]  # the suffix after it has its place
                sign = -1 if kind else 1
                heap = list(zip((sign * place[ready + 1]).tolist(), ready.tolist(), strict=True))
                heapq.heapify(heap)
                found, where = [], []
                values = dict(zip(rest.tolist(), (s[rest] - a).tolist(), strict=True))
                while heap:
                    _, j = heapq.heappop(heap)
                    c = values[j]
                    if kind:
                        next_[c] -= 1
                    h = next_[c]
                    if not kind:
                        next_[c] += 1
                    found.append(j)
                    where.append(h)
                    if j - 1 in waits:
                        heapq.heappush(heap, (sign * h, j - 1))
                sa[where], place[found] = found, where
    return sa


def _new(s: np.ndarray, ranked: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """For each leftmost-smaller substring but the first of ranked, in their order, whether it differs from the one before; s[a:stop] each, the last of the text from all."""
    n = len(s)
    a, b, za, zb = ranked[:-1], ranked[1:], stops[:-1], stops[1:]
    differs = (za - a != zb - b) | (za > n) | (zb > n)
    open_, k = np.flatnonzero(~differs), 0
    while len(open_):
        same = s[a[open_] + k] == s[b[open_] + k]
        differs[open_[~same]] = True
        k += 1
        open_ = open_[same & (a[open_] + k < za[open_])]
    return differs


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of s (integers from 0) by induced sorting; a suffix that is a prefix of another comes first.

    Suffixes are classified as smaller or larger than the next one. The substrings between leftmost-smaller ones are
    sorted by induction and named by rank; if names repeat, the suffixes of the string of names are sorted in the same
    way; their order induces all others'.
    """
    n = len(s)
    if n < 2:
        return np.arange(n)
    step = np.concatenate((np.sign(np.diff(s.astype(np.int64))), [-1]))
    turns = np.flatnonzero(step)
    smaller = step[turns[np.searchsorted(turns, np.arange(n))]] > 0
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    by_symbol = np.argsort(s.astype(np.uint16) if s.max() < 1 << 16 else s, kind="stable")  # 16 bits: by radix
    s = s.astype(np.int64)
    order = _induce(s, smaller, by_symbol, lms)
    if not len(lms):
        return order
    at = np.full(n, -1)
    at[lms] = np.arange(len(lms))
    ranked = order[at[order] >= 0]
    stops = np.concatenate((lms[1:] + 1, [n + 1]))
    names = np.concatenate(([0], np.cumsum(_new(s, ranked, stops[at[ranked]]))))
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[at[ranked]] = names
        ranked = lms[suffix_array(reduced)]
    return _induce(s, smaller, by_symbol, ranked)


def common_prefixes(text: bytes, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Permuted: for each position its suffix's common prefix with the suffix before it in sa, within both their rooms.

    room counts the bytes from each position to the end of its string. Where the bytes before two neighbours are equal
    too, those before are neighbours with one byte more in common; so only the other positions are compared.
    """
    n = len(text)
    s = np.frombuffer(text, np.uint8)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    fresh_ = np.ones(n, bool)
    i = np.flatnonzero(before > 0)
    i = i[i > 0]
    fresh_[i] = (s[i - 1] != s[before[i] - 1]) | (room[i - 1] == 0)
    words = np.ndarray((n,), "<u8", text + bytes(8), 0, (1,))
    i = np.flatnonzero(fresh_ & (before >= 0))
    p = before[i]
    most = np.minimum(room[i], room[p])
    length = np.zeros(len(i), np.int64)
    open_ = np.flatnonzero(most > 0)
    while len(open_):
        other = words[i[open_] + length[open_]] ^ words[p[open_] + length[open_]]
        lowest = other & (~other + U(1))
        length[open_] += np.where(other == 0, 8, np.bitwise_count(lowest - U(1)) >> 3)
        open_ = open_[(other == 0) & (length[open_] < most[open_])]
    out = np.zeros(n, np.int64)
    out[i] = np.minimum(length, most)
    last = np.maximum.accumulate(np.where(fresh_, np.arange(n), 0))
    return out[last] - (np.arange(n) - last)


def repeats(strings: list[bytes], window: int, earlier: np.ndarray) -> np.ndarray:
    """Whether each window of distinct strings, one after the other, has an equal one that starts earlier; earlier ranks all windows."""
    sizes = np.array([len(x) for x in strings], np.int64)
    text = b"\xff".join(strings) + b"\xff"
    room = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1) - np.arange(len(text))
    sa = suffix_array(np.frombuffer(text, np.uint8))
    shared = common_prefixes(text, sa, room)[sa] >= window
    number = np.cumsum(room >= window) - 1
    run = np.flatnonzero(shared | np.concatenate((shared[1:], [False])))  # members of runs of two or more
    out = np.zeros(len(earlier), bool)
    if len(run):
        own = number[sa[run]]
        first = np.flatnonzero(~shared[run])
        least = np.minimum.reduceat(earlier[own], first)
        out[own] = earlier[own] > np.repeat(least, np.diff(np.concatenate((first, [len(run)]))))
    return out


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == U else c.astype(np.int64)) for c in columns], names)


def _all_anchors(rows: DataFrame, window: int, gram: int, only_gram: bool) -> DataFrame:
    """(gram) or (gram, context, doc, tie, place) of all anchors; place packs the gram's position, its offset and the count of windows."""
    names = ["gram"] if only_gram else ["gram", "context", "doc", "tie", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            doc, tie = (batch.column(c).to_numpy() for c in ("doc", "tie"))
            for group in segments(as_bytes(batch.column("text")), window):
                g, c, which, at, offset, count = anchors(group, window, gram)
                yield _batch(names, g) if only_gram else _batch(names, g, c, doc[which], tie[which], (at << 2 * SMALL) | (offset << SMALL) | count)

    return rows.mapInArrow(run, ", ".join(f"{n} long" for n in names))


PIECE = "gram long, doc long, tie long, at long, gap int, bytes binary"
_NAMES = ["gram", "doc", "tie", "at", "gap", "bytes"]


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)], _NAMES)


def shard_spans(rows: list[tuple[int, int, int, int, int, bytes]], window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(doc, tie, start, length) of what is repeated in a shard: rows (gram, doc, tie, at, gap, bytes), the gram at `at` of the text, gap bytes into bytes."""
    strings = [r[5] for r in rows]
    windows = np.array([len(x) for x in strings], np.int64) - window + 1
    base = np.cumsum(windows) - windows
    doc, tie, start = (np.array(x, np.int64) for x in zip(*((r[1], r[2], r[3] - r[4]) for r in rows), strict=True))
    owner = np.repeat(np.arange(len(rows)), windows)
    at = np.repeat(start - base, windows) + np.arange(len(owner))
    rank = np.empty(len(owner), np.int64)
    rank[np.lexsort((at, tie[owner], doc[owner]))] = np.arange(len(owner))
    again = np.flatnonzero(repeats(strings, window, rank))
    cuts = np.flatnonzero(np.concatenate(([True], (np.diff(again) > 1) | (np.diff(owner[again]) > 0)))) if len(again) else again
    ends = np.concatenate((cuts[1:], [len(again)])).astype(np.int64) - 1 if len(again) else again
    first = again[cuts]
    return doc[owner[first]], tie[owner[first]], at[first], again[ends] - first + window


def _shards(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over pieces sorted by gram and place: whole grams' contexts, SHARD_BYTES at a time, those of repeated rows once."""

    def flush(held: list[tuple]) -> pa.RecordBatch:
        doc, tie, start, length = shard_spans(held, window)
        return _batch(["doc", "tie", "span"], doc, tie, (start << SMALL) | length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = last = 0  # bytes held, and where the last gram of held begins
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != held[-1][0]:
                    if len(held) - last == 1:  # a gram of one piece holds no repeat
                        size -= len(held.pop()[5])
                    if size >= SHARD_BYTES:
                        yield flush(held)
                        held, size = [], 0
                    last = len(held)
                if held and row[:4] == held[-1][:4]:
                    continue
                held.append(row)
                size += len(row[5])
        if len(held) - last == 1:
            held.pop()
        if held:
            yield flush(held)

    return run


def compared(one: bytes, gap: int, other: bytes, other_gap: int) -> tuple[int, int]:
    """Bytes that two contexts share to the left of their grams' starts, and from there to the right."""
    left, most = 0, min(gap, other_gap)
    if one[gap - most : gap] == other[other_gap - most : other_gap]:
        left = most
    else:
        while one[gap - left - 1] == other[other_gap - left - 1]:
            left += 1
    right, most = 0, min(len(one) - gap, len(other) - other_gap)
    if one[gap : gap + most] == other[other_gap : other_gap + most]:
        right = most
    else:
        while one[gap + right] == other[other_gap + right]:
            right += 1
    return left, right


def dealt(gap: int, n_windows: int, left: int, right: int, window: int) -> tuple[tuple[int, int], ...]:
    """Ranges (from, to) of the gram's offset in a context's windows: those within what it shares, over its right end, and over its left end only."""
    most, least = gap, gap - n_windows + 1
    return (max(least, window - right), min(most, left)), (least, min(most, window - right - 1)), (max(least, left + 1, window - right), most)


def _deal_on(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces beside their group's earliest one, as pieces of new groups; a span has a null in place of bytes, its start as `at` and its length as gap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for gram, doc, tie, at, gap, text, first_doc, first_tie, first_at, first_gap, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (doc, tie, at) == (first_doc, first_tie, first_at):
                    continue  # the earliest is nobody's repeat
                left, right = compared(text, gap, first, first_gap)
                same, over_right, over_left = dealt(gap, len(text) - window + 1, left, right, window)
                if same[0] <= same[1]:
                    out.append((gram, doc, tie, at - same[1], same[1] - same[0] + window, None))
                for side, length, (a, z) in ((b"r", right, over_right), (b"l", left, over_left)):
                    if a <= z:
                        beyond = text[gap + right] if side == b"r" else text[gap - left - 1]
                        group = xxhash.xxh64_intdigest(b"%s%d,%d" % (side, length, beyond), gram & (2**64 - 1))
                        out.append((group - (1 << 64) if group >> 63 else group, doc, tie, at, z, text[gap - z : gap - a + window]))
            yield _piece_batch(out)

    return run


def _identity(key: str, text: str) -> tuple[Column, Column]:
    """What rows go by: the key as a number, and the text's hash."""
    return F.coalesce(F.col(key).try_cast("long"), F.lit(-(1 << 63))), F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM, most: int = SHARD_CONTEXTS) -> DataFrame:
    """(doc, tie, spans array<long>): byte ranges covered by windows that start earlier too, packed as start * 2**12 + length.

    doc is the row's key (the least long, if it has none) and tie its text's hash, which rows of one key are told apart
    by. Earlier: in a row of smaller (doc, tie), or before in the same one; overlaps count. Rows that share both count as
    one given more than once, whose spans hold for each. Rows without any are left out.
    """
    if not gram <= window < 1 << (SMALL - 1):
        raise ValueError(f"window must be from {gram} to {(1 << (SMALL - 1)) - 1}")
    doc, tie = _identity(key, text)
    rows = docs.select(doc.alias("doc"), tie.alias("tie"), F.col(text).cast("string").alias("text"))
    own, spark = ["doc", "tie"], docs.sparkSession
    shared = cut(_all_anchors(rows, window, gram, True).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"))
    release(spark)
    found = cut(_all_anchors(rows, window, gram, False).join(shared, "gram"))
    discard(shared)
    classes = cut(found.groupBy("gram", "context").agg(F.min(F.struct("doc", "tie", "place")).alias("first")))
    later = found.join(classes, ["gram", "context"]).where(~((F.col("doc") == F.col("first.doc")) & (F.col("tie") == F.col("first.tie")) & (F.col("place") == F.col("first.place"))))
    small, ones = F.lit((1 << SMALL) - 1), F.shiftright("place", 2 * SMALL)
    start, n_windows = ones - F.shiftright("place", SMALL).bitwiseAND(small), F.col("place").bitwiseAND(small)
    spans = [cut(later.select("doc", "tie", F.shiftleft(start, SMALL).bitwiseOR(n_windows + F.lit(window - 1)).alias("span")))]
    discard(found)
    many = cut(classes.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", (F.col("n") > most).alias("hot")))
    each = classes.join(many, "gram").groupBy("first.doc", "first.tie").agg(F.collect_list("gram").alias("grams"), F.collect_list(F.shiftleft("first.place", 1).bitwiseOR(F.col("hot").cast("long"))).alias("places"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            out: list[list] = [[] for _ in range(7)]
            for d, t, whole, grams, places in zip(batch.column("doc").to_pylist(), batch.column("tie").to_pylist(), as_bytes(batch.column("text")), batch.column("grams"), batch.column("places"), strict=True):
                place = places.values.to_numpy()
                at, gap, n = place >> (2 * SMALL + 1), (place >> (SMALL + 1)) & ((1 << SMALL) - 1), (place >> 1) & ((1 << SMALL) - 1)
                begin = at - gap
                cuts = [whole[a:z] for a, z in zip(begin.tolist(), (begin + n + window - 1).tolist(), strict=True)]
                for o, x in zip(out, (grams.values.to_pylist(), [d] * len(place), [t] * len(place), at.tolist(), gap.tolist(), cuts, (place & 1).astype(bool).tolist()), strict=True):
                    o.extend(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(o, kind) for o, kind in zip(out, kinds, strict=True)], [*_NAMES, "hot"])

    contexts = cut(rows.join(each, own).mapInArrow(extract, f"{PIECE}, hot boolean"))
    discard(classes, many)

    pieces, used = [contexts.where("not hot").drop("hot")], [contexts]
    level = contexts.where("hot").drop("hot")
    while level.limit(1).count():
        groups = cut(level.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "tie", "at", "gap", "bytes")).alias("first")).where("n > 1"))
        pieces.append(level.join(groups.where(F.col("n") <= most).select("gram"), "gram").select(*_NAMES))
        firsts = groups.where(F.col("n") > most).select("gram", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "first.*").toDF("gram", "salt", *(f"first_{c}" for c in _NAMES[1:]))
        salted = level.withColumn("salt", F.pmod(F.xxhash64("tie", "at"), F.lit(SALTS)).cast("int")).join(firsts, ["gram", "salt"])
        made = cut(salted.select(*_NAMES, *(f"first_{c}" for c in _NAMES[1:])).mapInArrow(_deal_on(window), PIECE))
        spans.append(made.where("bytes is null").select(*own, F.shiftleft("at", SMALL).bitwiseOR(F.col("gap").cast("long")).alias("span")))
        level = made.where("bytes is not null")
        used += [groups, made]
    sharded = reduce(DataFrame.union, pieces).repartition("gram").sortWithinPartitions(*_NAMES[:4])
    spans.append(cut(sharded.mapInArrow(_shards(window), "doc long, tie long, span long")))
    out = cut(reduce(DataFrame.union, spans).groupBy(*own).agg(F.collect_list("span").alias("spans")))
    discard(*used, spans[0], spans[-1])
    return out


def merged(spans: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Packed spans as maximal runs within size, in order."""
    if not len(spans):
        return []
    spans = np.sort(spans)
    start = spans >> SMALL
    reach = np.maximum.accumulate(np.minimum(start + (spans & ((1 << SMALL) - 1)), size))
    first = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return list(zip(start[first].tolist(), reach[np.concatenate((first[1:], [len(reach)])) - 1].tolist(), strict=True))


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, z in runs:
        kept.append(text[at:a])
        at = z
    return b"".join([*kept, text[at:]])


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """runs without the bytes of characters that they only cut into."""
    out = []
    for a, z in runs:
        while a < z and text[a] & 0xC0 == 0x80:
            a += 1
        while z > a and z < len(text) and text[z] & 0xC0 == 0x80:
            z -= 1
        if a < z:
            out.append((a, z))
    return out


def _with_spans(docs: DataFrame, key: str, text: str, window: int) -> tuple[DataFrame, str]:
    """docs with each row's packed spans, and the name of their column."""
    spans = repeated_spans(docs, key, text, window)
    doc, tie, found = (fresh(docs, x) for x in ("doc__", "tie__", "spans__"))
    return docs.withColumns(dict(zip((doc, tie), _identity(key, text), strict=True))).join(spans.toDF(doc, tie, found), [doc, tie], "left").drop(doc, tie), found


def _packed(column: pa.Array) -> list[np.ndarray]:
    return [np.zeros(0, np.int64) if not x.is_valid else x.values.to_numpy() for x in column]


def removal_report(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256) of every row; the digest is of the remaining bytes, concatenated.

    Rows go in the order of their keys as numbers, those without first, and rows of one key in that of their texts'
    hashes; rows that share key and text are one document given more than once, with the same result. Null texts are
    empty, and texts shorter than window keep all they have. Long texts are worked on whole. An empty table has no rows.
    """
    rows, spans = _with_spans(docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")), "key", "text", window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            out: list[list] = [[], [], [], []]
            for whole, own in zip(as_bytes(batch.column("text")), _packed(batch.column(spans)), strict=True):
                runs = merged(own, len(whole))
                for o, v in zip(out, (len(whole), sum(z - a for a, z in runs), len(runs), hashlib.sha256(without(whole, runs)).hexdigest()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.string())], ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("key", key)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, drop_emptied: bool = True) -> DataFrame:
    """docs with each text's repeated passages cut out, whole characters only; all other columns stay as they are.

    Rows are told apart and ordered as removal_report does. A text that nothing is left of goes with its row (drop_emptied), unless
    it was empty before; null texts stay null.
    """
    names, schema = docs.columns, docs.schema
    rows, spans = _with_spans(docs, key, text, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text):
            made, keep = [], []
            for whole, own in zip(batch.column(text).to_pylist(), _packed(batch.column(spans)), strict=True):
                if len(own):
                    raw = whole.encode()
                    whole = without(raw, whole_characters(raw, merged(own, len(raw)))).decode()
                made.append(whole)
                keep.append(not (len(own) and drop_emptied and not whole))
            out = pa.RecordBatch.from_arrays([pa.array(made, pa.string()) if c == text else batch.column(c) for c in names], names)
            yield out.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, schema)

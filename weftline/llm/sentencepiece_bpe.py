"""Merge-type SentencePiece encoding by a prefix table, and decoding.

A prefix of a text has one encoding, and so one last token. Token t is the last one of a prefix if t matches at its end
and may follow the last token of the prefix before t: encoding the two tokens' text must give the two again. So one
walk over the matches of an automaton fills the table from left to right, and the ids are read off backwards.
Merging never crosses from other text into white space if no piece does, so the walk is made for each word, and words
that come again are taken from a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shipped, as_bytes, small_batches

SPACE = "▁"
#: Words that a worker keeps in each of two generations, and their longest.
MOST_WORDS, LONGEST_WORD = 300_000, 64


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a serialized protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = number(at)
        kind = tag & 7
        if kind == 0:
            value, at = number(at)
        elif kind == 2:
            size, at = number(at)
            value, at = data[at : at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """The pieces of a merge-type model with the identity normalizer."""

    def __init__(self, data: bytes) -> None:
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_proto=data)
        parts = dict(_fields(data))
        norm = dict(_fields(parts.get(3, b"")))
        trainer = dict(_fields(parts.get(2, b"")))
        if trainer.get(3, 1) != 2 or norm.get(2) or norm.get(4, 1) or not norm.get(5, 1) or trainer.get(24):
            raise ValueError("this isn't a merge-type model with the identity normalizer")
        self.dummy_prefix = bool(norm.get(3, 1))
        size = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(size)]
        self.normal = {p: i for i, p in enumerate(self.pieces) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))}
        self.score = [lib.get_score(i) for i in range(size)]
        self.unknown = lib.unk_id()
        self.bytes_of = {int(self.pieces[i][1:-1], 16): i for i in range(size) if lib.is_byte(i)}
        self.surface = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in self.bytes_of.items():
            self.surface[i] = bytes([b])
        for i in range(size):
            if lib.is_control(i):
                self.surface[i] = b""
        self.surface[self.unknown] = " ⁇ ".encode()
        self.by_word = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.normal)
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.normal.items():
            if self.merged(p) == [i]:  # others are never made
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.words: dict[str, tuple[bytes, bytes]] = {}
        self.before: dict[str, tuple[bytes, bytes]] = {}  # words of the generation before

    def merged(self, text: str) -> list[int]:
        """The encoding by the definition: merge the best pair, the leftmost of equals, until none is a piece. -1: no piece."""
        parts = list(text)
        normal, score = self.normal, self.score
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                i = normal.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or score[i] > best):
                    best, where = score[i], k
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return [normal.get(p, -1) for p in parts]

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            known = self.merged(self.pieces[a] + self.pieces[b]) == [a, b]
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def encode_word(self, text: str) -> list[int]:
        """Ids of a text by the prefix table."""
        n = len(text)
        last, size = [-2] * (n + 1), [1] * (n + 1)  # -2: none yet; -1: a character that is no piece
        done, pairs = 0, self.pairs
        for end, (token, length) in self.automaton.iter(text):
            while done < end:  # a place where no piece ends
                done += 1
                if last[done] == -2:
                    last[done] = -1
            end += 1
            if last[end] != -2:
                continue
            before = end - length
            if before:
                a = last[before]
                if a >= 0:
                    known = pairs.get(a << 20 | token)
                    if known is None:
                        known = self.follows(a, token)
                    if not known:
                        continue
            last[end], size[end] = token, length
        ids: list[int] = []
        while n:
            token = last[n]
            if token >= 0:
                ids.append(token)
            elif self.bytes_of:
                ids.extend(self.bytes_of[b] for b in reversed(text[n - 1].encode()))
            else:
                ids.append(self.unknown)
            n -= size[n]
        ids.reverse()
        return ids

    def _word(self, text: str) -> tuple[bytes, bytes]:
        """A word's ids, in decimal and joined by commas, and what they decode to."""
        known = self.before.get(text)
        if known is None:
            ids = self.encode_word(text)
            known = b",".join([b"%d" % i for i in ids]), b"".join([self.surface[i] for i in ids])
        if len(text) <= LONGEST_WORD:
            if len(self.words) >= MOST_WORDS:
                self.before, self.words = self.words, {}
            self.words[text] = known
        return known

    def _split(self, text: str) -> list[str]:
        text = text.replace(" ", SPACE)
        if self.dummy_prefix:
            text = SPACE + text
        if not self.by_word:
            return [text]
        if SPACE * 2 in text or not text.startswith(SPACE):
            return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)
        return [SPACE + x for x in text[1:].split(SPACE)]

    def digest_parts(self, text: str) -> tuple[bytes, bytes]:
        """All ids in decimal, joined by commas, and the decoding of those ids in UTF-8."""
        if not text:
            return b"", b""
        known = self.words
        found = [known.get(w) or self._word(w) for w in self._split(text)]  # if a generation ends meanwhile, the next text sees the new one
        decoded = b"".join([x[1] for x in found])
        if self.dummy_prefix and decoded.startswith(b" "):
            decoded = decoded[1:]
        return b",".join([x[0] for x in found]), decoded.decode("utf-8", "replace").encode()

    def encode(self, text: str) -> list[int]:
        ids = self.digest_parts(text)[0]
        return [int(i) for i in ids.split(b",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        data = b"".join([self.surface[i] for i in ids])
        first = next((i for i in ids if self.surface[i]), None)
        if self.dummy_prefix and first is not None and self.pieces[first].startswith(SPACE):
            data = data[1:]
        return data.decode("utf-8", "replace")


_models: dict[str, Model] = {}


def model(shipped: Shipped) -> Model:
    """One model for each Python worker."""
    if shipped.mark not in _models:
        _models[shipped.mark] = Model(shipped.data.value)
    return _models[shipped.mark]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>, decoded string); null texts count as empty and have no ids. Repeated rows stay repeated."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    shipped = Shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(shipped)
        for batch in small_batches(batches, "text"):
            ids = [m.encode(x or "") for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(x) for x in ids], pa.string())], ["key", "ids", "decoded"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, ids array<int>, decoded string").withColumnRenamed("key", key)


def encode_digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of the decimal ids joined by commas and of the decoded text.

    Null texts are empty: no ids, and nothing decoded. Texts of any length are encoded whole, repeated rows stay
    repeated, and an empty table has no rows. Decoding joins the pieces of the ids by the library's rules, a word at a
    time and with the word's ids in one cache; the library's own decode(ids) would need all ids as Python integers once
    more. Tests hold both against the library.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    shipped = Shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(shipped)
        for batch in small_batches(batches, "text"):
            n, a, b = [], [], []
            for x in as_bytes(batch.column("text")):
                ids, decoded = m.digest_parts(x.decode())
                n.append(ids.count(b",") + 1 if ids else 0)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)

"""Token ids in ORC files: integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are dealt out by ranges of their ids, encoded where they arrive, and written in that order, so the files of
one folder follow each other and each stripe's minimum and maximum id prune it. Stripes can be read in parallel.

Encoding whole texts spends most of its time on words that it has had before. The byte-level pattern never joins other
text to white space after it, so a text is cut there; a piece that a worker has had before is taken from a bounded
cache, and any other is encoded by the tokenizers library. Added tokens are found first, as the library finds them, and
the texts between them are encoded each for itself. Where a space stands between other characters, the pattern has a cut
before it: a text that has spaces only there is split at them, and what is between two spaces is looked up at once.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Shipped, cut, small_batches

#: White space as the pattern of byte-level tokenizers has it (fixed values).
WHITE = "\t-\r \x85\xa0  -     　"
CHUNKS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The byte-level pattern (a fixed value), with white space spelled out.
PATTERN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Texts of characters below this one are cut by PATTERN here; others by the library, whose Unicode tables count.
PLAIN = re.compile("[\0-ɏ]*")
#: The letters among those characters, and a word of them with ASCII marks after it: the pattern's two pieces of such a chunk.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
WORD = re.compile(rf"( ?[{LETTERS}]+)([!-&(-/:-@\[-`{{-~]*)")
WHITE_SET = frozenset(re.findall(f"[{WHITE}]", "".join(map(chr, range(0x3001)))))
SPACED_WORD = re.compile(WORD.pattern.replace(" ?", "", 1))
#: Chunks that a worker keeps in each of two generations, and their longest.
MOST_CHUNKS, LONGEST_CHUNK = 300_000, 64


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Spaced(dict):
    """ids of what stands between two spaces, with the space before it; None of what has white space at an edge."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder, self.before = encoder, {}  # pieces of the generation before

    def _keep(self, piece: str, known: bytes) -> bytes:
        if len(piece) < LONGEST_CHUNK:
            if len(self) >= MOST_CHUNKS:
                self.before = dict(self)
                self.clear()
            self[piece] = known
        return known

    def _word(self, word: str) -> bytes:
        return self.before.get(word) or self.encoder._part(" " + word)

    def __missing__(self, piece: str) -> bytes | None:
        known = self.before.get(piece)
        if known is None:
            made = SPACED_WORD.fullmatch(piece)
            if made:
                word, marks = made.groups()
                if marks:
                    known = (self.get(word) or self._keep(word, self._word(word))) + (self.encoder.marks.get(marks) or self.encoder._marks(marks))
                else:
                    known = self.encoder._part(" " + word)
            elif not piece or piece[0] in WHITE_SET or piece[-1] in WHITE_SET:
                return None
            else:
                return self.encoder.pieces(" " + piece)
        return self._keep(piece, known)


class Encoder:
    """Encodes texts as the library does, ids as little-endian unsigned 32-bit integers."""

    def __init__(self, data: bytes, special: bool = False) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_buffer(data)
        self.library.encode_special_tokens = not special  # else the special tokens' strings in a text are those tokens
        made = json.loads(data)
        pre = made.get("pre_tokenizer") or {}
        added = [x for x in made.get("added_tokens", ()) if x["content"] and (special or not x.get("special"))]
        plain = not any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
        self.cuts = not made.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and plain
        self.added = {x["content"]: x["id"].to_bytes(4, "little") for x in added}
        self.split = re.compile("({})".format("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))))).split if added else None  # leftmost, then longest
        self.tokenize = self.library.model.tokenize
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.ids = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.chunks: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}  # chunks of the generation before
        self.marks: dict[str, bytes] = {}
        self.spaced = Spaced(self)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        if part.isascii():
            letters = part.translate(self.letters)
        else:
            letters = part.encode().decode("latin-1").translate(self.letters)
        ids = self.ids
        return b"".join([ids[t.id] for t in self.tokenize(letters)])

    def _keep(self, chunk: str, known: bytes) -> None:
        if len(chunk) <= LONGEST_CHUNK:
            if len(self.chunks) >= MOST_CHUNKS:
                self.before, self.chunks = self.chunks, {}
            self.chunks[chunk] = known

    def _chunk(self, chunk: str) -> bytes:
        known = self.before.get(chunk)
        if known is None:
            made = WORD.fullmatch(chunk)
            if made:
                word, marks = made.groups()
                known = (self.chunks.get(word) or self.before.get(word)) if marks else None
                if known is None:
                    known = self._part(word)
                    if marks:
                        self._keep(word, known)
                if marks:
                    known += self.marks.get(marks) or self._marks(marks)
            elif PLAIN.fullmatch(chunk):
                known = b"".join([self._part(p) for p in PATTERN.findall(chunk)])
            else:
                known = self._whole(chunk)
        self._keep(chunk, known)
        return known

    def _marks(self, marks: str) -> bytes:
        known = self._part(marks)
        if len(marks) <= 3:  # there are under 30,000 of them
            self.marks[marks] = known
        return known

    def encode(self, text: str) -> bytes:
        if not self.cuts:
            return self._whole(text)
        if self.split:
            parts = self.split(text)
            if len(parts) > 1:  # every second part is an added token
                return b"".join([self.added[p] if i % 2 else self._between(p) for i, p in enumerate(parts)])
        return self._between(text)

    def _between(self, text: str) -> bytes:
        """Cut at each space that stands between other characters, which is a cut between chunks too; else into chunks."""
        first, *others = text.split(" ")
        if others and first and first[-1] not in WHITE_SET:
            try:
                return self.pieces(first) + b"".join(map(self.spaced.__getitem__, others))
            except TypeError:  # None: white space beside a space
                pass
        return self.pieces(text)

    def pieces(self, text: str) -> bytes:
        known = self.chunks
        return b"".join([known.get(c) or self._chunk(c) for c in CHUNKS.findall(text)])


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(shipped: Shipped, special: bool) -> Encoder:
    """One encoder for each Python worker."""
    if (shipped.mark, special) not in _encoders:
        _encoders.clear()
        _encoders[shipped.mark, special] = Encoder(shipped.data.value, special)
    return _encoders[shipped.mark, special]


def write_token_files(docs: DataFrame, tokenizer: str, out: str, key: str = "doc_id", text: str = "text", end_id: int | None = 0, special: bool = False) -> None:
    """Writes (doc_id, ids array<int>, ord) to ORC files in ascending key order, end_id after each document's ids.

    Null keys come first; rows of one key stand in the order of their texts' hashes, repeated ones beside each other, and
    can go to several files, which follow each other by their numbers; null texts are empty. Long texts are encoded
    whole. ord numbers a file's rows. special: take special tokens' strings in texts as those tokens (by default they are
    ordinary text). An empty table makes files without rows.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    by = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    end, shipped = b"" if end_id is None else end_id.to_bytes(4, "little"), Shipped(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, at = encoder(shipped, special), 0
        for batch in small_batches(batches, "text"):
            ids = [e.encode(x) + end for x in batch.column("text").to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(np.arange(at, at + len(ids)))], ["doc_id", "ids", "ord"])
            at += len(ids)

    made = ordered.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, ord long")
    made.write.mode("overwrite").options(**{"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": "1000", "compression": "zstd"}).orc(out)


def read_documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """Some documents' tokens; row indexes and Bloom filters leave out the stripes and row groups without them."""
    return spark.read.orc(path).where(F.col("doc_id").isin(ids)).select("doc_id", "ids")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files in path, as read back: start counts all ids of documents before."""
    rows = spark.read.orc(path).select("doc_id", "ids", "ord", F.regexp_extract(F.input_file_name(), r"part-(\d+)", 1).cast("long").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            data = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(data[a * 4 : z * 4]) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ord"), batch.column("file"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "ord", "file", "n_tokens", "ids_crc32"])

    found = cut(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ord long, file long, n_tokens long, ids_crc32 long"))
    files = found.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    running = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row for each file
    starts = files.select("file", (F.sum("n").over(running) - F.col("n")).alias("before"))
    within = Window.partitionBy("file").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return found.join(starts, "file").select("doc_id", (F.col("before") + F.sum("n_tokens").over(within) - F.col("n_tokens")).alias("start"), "n_tokens", "ids_crc32")

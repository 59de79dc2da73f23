"""Media columns: Netpbm and BMP images as numpy arrays, area-resized by integral images, in NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, small_batches

#: Rows of an image that the integral image holds at once.
STRIP = 4096
_HEAD = re.compile(rb"P([1-6])((?:[ \t\r\n]|#[^\n]*\n)+)(\d+)(?:(?:[ \t\r\n]|#[^\n]*\n)+)(\d+)(?:(?:(?:[ \t\r\n]|#[^\n]*\n)+)(\d+))?")


def decode_netpbm(data: bytes) -> np.ndarray:
    """PBM, PGM or PPM, plain or raw, as (height, width) or (height, width, 3); 16-bit samples as uint16. PBM: 0 black, 255 white."""
    kind = data[1:2]
    head = (_HEAD if kind in b"2356" else re.compile(_HEAD.pattern.rpartition(b"(?:(?:(?:")[0])).match(data)
    if not head:
        raise ValueError("not a Netpbm image")
    width, height = int(head[3]), int(head[4])
    most = 1 if kind in b"14" else int(head[5] or 0)
    if not 0 < most < 65536:
        raise ValueError("bad Netpbm header")
    shape = (height, width, 3) if kind in b"36" else (height, width)
    n = height * width * (3 if kind in b"36" else 1)
    if not 0 < n <= 8 * len(data):  # a byte holds eight samples at most
        raise ValueError("empty or truncated Netpbm image")
    if kind in b"123":
        body = re.sub(rb"#[^\n]*", b"", data[head.end() :])
        samples = [int(x) for x in (re.findall(rb"[01]", body) if kind == b"1" else body.split()[:n])][:n]
        if max(samples, default=0) > most:
            raise ValueError("a Netpbm sample is over its largest")
        flat = np.array(samples, np.uint16)
    elif kind == b"4":
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, row * height, head.end() + 1).reshape(height, row)
        flat = np.unpackbits(packed, axis=1)[:, :width].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, head.end() + 1)
    if len(flat) != n:
        raise ValueError("truncated Netpbm image")
    if most == 1 and kind in b"14":
        return ((1 - flat) * 255).astype(np.uint8).reshape(shape)
    return flat.astype(np.uint8 if most < 256 else np.uint16).reshape(shape)


def encode_netpbm(image: np.ndarray) -> bytes:
    """Raw PGM or PPM of 8-bit samples."""
    kind = b"P5" if image.ndim == 2 else b"P6"
    return b"%s\n%d %d\n255\n" % (kind, image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as (height, width) if its palette is grey, else (height, width, 3)."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    offset, head, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or depth not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("this kind of BMP isn't read")
    if packing == 3 and (depth != 32 or len(data) < 66 or struct.unpack_from("<III", data, 54) != (0xFF0000, 0xFF00, 0xFF)):
        raise ValueError("BMP masks other than those of plain 32 bits aren't read")
    row, tall = (width * depth + 31) // 32 * 4, abs(height)
    if row * tall > len(data):
        raise ValueError("truncated BMP image")
    pixels = np.frombuffer(data, np.uint8, row * tall, offset).reshape(tall, row)
    pixels = pixels[::-1] if height > 0 else pixels
    if depth >= 24:
        return np.ascontiguousarray(pixels[:, : width * depth // 8].reshape(tall, width, depth // 8)[:, :, 2::-1])
    colours = struct.unpack_from("<I", data, 46)[0] or 1 << depth
    palette = np.zeros((1 << depth, 3), np.uint8)
    own = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(colours, 4)[:, 2::-1]
    palette[:colours] = own
    if depth < 8:
        bits = np.unpackbits(pixels, axis=1).reshape(tall, -1, depth)
        pixels = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2)
    image = palette[pixels[:, :width]]
    return np.ascontiguousarray(image[:, :, 0]) if (own == own[:, :1]).all() else image


def encode_bmp(image: np.ndarray) -> bytes:
    """Uncompressed BMP: 8 bits with a grey palette, or 24 bits."""
    height, width = image.shape[:2]
    depth = 8 if image.ndim == 2 else 24
    row = (width * depth + 31) // 32 * 4
    body = np.zeros((height, row), np.uint8)
    body[:, : width * depth // 8] = (image if image.ndim == 2 else image[:, :, ::-1]).reshape(height, -1)
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy() if depth == 8 else np.zeros((0, 4), np.uint8)
    palette[:, 3] = 0
    start = 54 + palette.size
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", start + body.size, 0, start, 40, width, height, 1, depth, 0, body.size, 2835, 2835, len(palette), 0) + palette.tobytes() + body[::-1].tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def to_npy(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def _edges(size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(parts + 1) * size
    return at // parts, at % parts


def area_sums(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """height x width sums over equal boxes of a grey image, times height * width: exact integers.

    The integral image is read at the boxes' edges, between its points in proportion. It is built a strip of rows at a
    time, of which only the rows beside edges are kept.
    """
    rows, cols = image.shape
    (r, rp), (c, cp) = _edges(rows, height), _edges(cols, width)
    need = np.unique(np.minimum(np.concatenate((r, r + 1)), rows))
    kept = np.zeros((len(need), cols + 1), np.int64)
    carry = np.zeros(cols + 1, np.int64)
    for top in range(0, rows, STRIP):
        strip = image[top : top + STRIP]
        integral = np.zeros((len(strip), cols + 1), np.int64)
        np.cumsum(np.cumsum(strip, axis=0, dtype=np.int64), axis=1, out=integral[:, 1:])
        integral += carry
        own = (need > top) & (need <= top + len(strip))
        kept[own] = integral[need[own] - top - 1]
        carry = integral[-1]
    by_row = kept[np.searchsorted(need, r)] * (height - rp)[:, None] + kept[np.searchsorted(need, np.minimum(r + 1, rows))] * rp[:, None]
    both = by_row[:, c] * (width - cp) + by_row[:, np.minimum(c + 1, cols)] * cp
    return np.diff(np.diff(both, axis=0), axis=1)


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mean over each of height x width equal boxes, rounded half up, with the image's type and channels."""
    if image.ndim == 3:
        return np.stack([area_resize(image[:, :, k], height, width) for k in range(image.shape[2])], axis=2)
    area = image.shape[0] * image.shape[1]
    return ((area_sums(image, height, width) * 2 + area) // (2 * area)).astype(image.dtype)


def difference_hash(image: np.ndarray, side: int = 8) -> str:
    """Hex of side * side bits: whether a box of the area-resized image is brighter than the one to its left."""
    grey = image if image.ndim == 2 else image.astype(np.uint16).sum(2)
    sums = area_sums(grey, side, side + 1)
    return np.packbits(sums[:, 1:] > sums[:, :-1]).tobytes().hex()


def tiles(media: DataFrame, key: str, image: str = "image", height: int = 64, width: int = 64) -> DataFrame:
    """(key, height, width, channels, tile binary, dhash): Netpbm and BMP bytes as resized NPY tiles with difference hashes.

    What can't be decoded has nulls: null and empty images, images of no width or height, other formats, and images that
    are shorter than their headers say. Large images are worked on a strip of rows at a time; repeated rows stay
    repeated, and an empty table has no rows.
    """
    rows = media.select(F.col(key).alias("key"), F.col(image).alias("image"))

    def one(data: bytes) -> tuple:
        try:
            x = decode(data)
            return x.shape[0], x.shape[1], x.shape[2] if x.ndim == 3 else 1, to_npy(area_resize(x, height, width)), difference_hash(x)
        except (ValueError, struct.error, IndexError):
            return (None,) * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "image"):
            made = list(zip(*map(one, as_bytes(batch.column("image"))), strict=True))
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x, t) for x, t in zip(made, kinds, strict=True))], ["key", "height", "width", "channels", "tile", "dhash"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, height int, width int, channels int, tile binary, dhash string").withColumnRenamed("key", key)


def payload(text: bytes, row: int = 64) -> np.ndarray:
    """Bytes as an 8-bit image of `row` columns and at least one row, filled up with 0."""
    return np.frombuffer(text.ljust(max(row, -(-len(text) // row) * row), b"\0"), np.uint8).reshape(-1, row)


def write_text_tiles(docs: DataFrame, out: str, key: str = "doc_id", text: str = "text", row: int = 64) -> None:
    """Writes (key, n_bytes, tile): each whole text's bytes as an image in an NPY tile, by way of its Netpbm form.

    Null texts are empty. Equal texts have equal tiles, and repeated rows stay repeated.
    """
    rows = docs.select(F.col(key).alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text__"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text__"):
            texts = as_bytes(batch.column("text__"))
            made = [to_npy(decode(encode_netpbm(payload(x, row)))) for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(x) for x in texts], pa.int64()), pa.array(made, pa.binary())], [key, "n_bytes", "tile"])

    rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_bytes long, tile binary").write.mode("overwrite").option("compression", "zstd").parquet(out)


def tile_features(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of stored tiles (key, n_bytes, tile) and of the payload that they decode to, and its difference hash."""
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def one(n: int, tile: bytes) -> tuple:
        image = from_npy(tile)
        data = image.tobytes()
        return n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(tile), hashlib.sha256(tile).hexdigest(), difference_hash(image)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "tile"):
            made = zip(*map(one, batch.column("n_bytes").to_pylist(), as_bytes(batch.column("tile"))), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(x, t) for x, t in zip(made, kinds, strict=True))], [key, *names])

    rows = stored.select(key, "n_bytes", "tile")
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")

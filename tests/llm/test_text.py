"""Quality selection, token files, media tiles, SentencePiece and M-trees."""

import hashlib
import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import common, importance, media, mtree, queries, sentencepiece_bpe, token_files

BYTE, PIECE = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("piece_bpe_32k.model")


def test_ngrams_by_hand():
    owner, bucket = importance.ngrams(*next(importance.pieces([b"Ab c!", b"", b"ab"])))
    assert sorted(owner.tolist()) == [0, 0, 0, 0, 0, 2] and bucket[owner == 2][0] in bucket[owner == 0]


def test_weights_do_not_depend_on_batches():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 103, n).astype(np.uint8)).replace(b"a", b" ") for n in (0, 10, 3000, 500, 1)]
    ratios = rng.integers(-1000, 1000, importance.BUCKETS)
    whole, n = importance.log_weights(texts, ratios)
    for i, t in enumerate(texts):
        one, k = importance.log_weights([t], ratios)
        assert (one[0], k[0]) == (whole[i], n[i])


def test_kth_largest(spark):
    values = [random.Random(4).randrange(-(10**12), 10**12) for _ in range(500)] + [7] * 20
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 100, 260, 520):
        want = sorted(values, reverse=True)[k - 1]
        assert importance.kth_largest(rows, "v", k, bins=16) == (want, sum(v > want for v in values))


def test_op2_keeps_the_good_and_drops_the_bad(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r["doc_id"] for r in queries.op2_quality(spark, sf).collect()}
    labels = common.table(spark, sf, "labels").collect()
    good, bad = [r["doc_id"] for r in labels if r["quality"]], [r["doc_id"] for r in labels if not r["quality"]]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert sum(i in kept for i in bad) <= 0.25 * len(bad)


def test_a_held_out_half_is_told_apart_too(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    kept = {r["doc_id"] for r in importance.resample(docs, labels.where("doc_id % 2 = 0")).collect()}
    odd = labels.where("doc_id % 2 = 1").collect()
    right = sum((r["doc_id"] in kept) == bool(r["quality"]) for r in odd)
    assert right >= 0.9 * len(odd)


def test_resampling_agrees_with_its_weights(spark, sf):
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    chosen = {r["doc_id"] for r in queries.op2_quality(spark, sf).collect()}
    rows = importance.resample(docs, labels)
    assert rows.columns == docs.columns and {r["doc_id"] for r in rows.collect()} == chosen


def test_resampling_odd_rows(odd, with_clashes, empty, spark):
    labels = spark.createDataFrame([(1, 1, 0), (7, 0, 0), (8, 1, None), (None, 1, 0), (99, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    assert importance.resample(empty, labels).count() == 0
    assert importance.resample(odd, labels.where("false")).count() == 0
    rows = importance.resample(with_clashes, labels)
    assert rows.columns == with_clashes.columns
    assert {1, 2, 8} <= {r["doc_id"] for r in rows.collect()} and not {3, 4, 5} & {r["doc_id"] for r in rows.collect()}
    named = odd.withColumn("doc_id", F.concat(F.lit("no "), F.col("doc_id").cast("string")))
    by_name = labels.withColumn("doc_id", F.concat(F.lit("no "), F.col("doc_id").cast("string")))
    assert {"no 1", "no 2", "no 8"} <= {r["doc_id"] for r in importance.resample(named, by_name).collect()}
    nulls = odd.withColumn("doc_id", F.when(F.col("doc_id") < 9, F.col("doc_id")))
    assert importance.resample(nulls, labels).where("doc_id is null").count() > 0


def brute_buckets(text: str | None) -> list[int]:
    """Buckets of a text's uni- and bigrams, a byte at a time."""
    m, base = (1 << 64) - 1, 0x9E3779B97F4A7C15
    mix = lambda h: (h := ((h ^ (h >> 32)) * 0xD6E8FEB86659FD93) & m) ^ (h >> 32)
    words, last = [], 0
    for b in (text or "").encode().lower():
        kind = 0 if chr(b) in " \t\n\v\f\r" else 1 if b > 127 or chr(b).isalnum() else 2
        if kind and kind == last:
            words[-1].append(b)
        elif kind:
            words.append([b])
        last = kind
    hashes = [mix(sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(w)) & m) for w in words]
    pairs = [mix((a * 0x9FB21C651E98DF25 + b) & m) for a, b in zip(hashes, hashes[1:], strict=False)]
    return [(h >> 20) % importance.BUCKETS for h in [*hashes, *pairs]]


def test_op2_against_brute_force(spark, sf):
    docs, labels = (common.table(spark, sf, n) for n in ("documents", "labels"))
    noise = {r["doc_id"]: (r["g"], r["t"]) for r in docs.select("doc_id", importance.gumbel(importance._own_hash(23, "doc_id", "text")).alias("g"), importance._own_hash(24, "doc_id", "text").alias("t")).collect()}
    grams = {r["doc_id"]: brute_buckets(r["text"]) for r in docs.collect()}
    good = {r["doc_id"] for r in labels.where("quality = 1 and coalesce(toxic, 0) = 0").collect()} & set(grams)
    fold = {r["doc_id"]: r["f"] for r in docs.select("doc_id", F.xxhash64("doc_id").bitwiseAND(F.lit(1)).alias("f")).collect()}

    def ratios(ids) -> list[int]:
        raw, target = Counter(b for g in grams.values() for b in g), Counter(b for i in ids for b in grams[i])
        n = importance.BUCKETS
        return [round((math.log((target[b] + 1) / (target.total() + n)) - math.log((raw[b] + 1) / (raw.total() + n))) * importance.UNIT) for b in range(n)]

    whole, others = ratios(good), [ratios([i for i in good if fold[i] != f]) for f in (0, 1)]
    weight = {i: sum(whole[b] for b in g) for i, g in grams.items()}
    held = sorted((sum(others[fold[i]][b] for b in grams[i]) for i in good if grams[i]), reverse=True)
    floor = held[math.ceil(0.99 * len(held)) - 1] - 8 * importance.UNIT
    drawable = [i for i in grams if grams[i]]
    k = sum(weight[i] >= floor for i in drawable)
    want = set(sorted(drawable, key=lambda i: (weight[i] + noise[i][0], noise[i][1]), reverse=True)[:k])
    got = {r["doc_id"]: r for r in queries.op2_quality(spark, sf).collect()}
    assert set(got) == want and 0 < len(want) < len(grams)
    for i, r in got.items():
        assert r["n_ngrams"] == len(grams[i]) and r["log_weight"] == pytest.approx(weight[i] / importance.UNIT, abs=1e-3)


def test_long_texts_lose_no_ngram_at_their_cuts():
    rng = random.Random(6)
    for _ in range(60):
        text = "".join(rng.choice(["ab", "é", " ", "\n", "!", "x" * 30, " c", ".."]) for _ in range(rng.randrange(200))).encode()
        whole = sorted(importance.ngrams(*next(importance.pieces([text])))[1].tolist()) if text else []
        parts = [b for g in importance.pieces([text, text], 40) for o, b in zip(*(x.tolist() for x in importance.ngrams(*g)), strict=True) if o == 1]
        assert sorted(parts) == whole == sorted(brute_buckets(text.decode()))


ODD_TEXTS = ["", " ", "  ", "a  b \n c ", "it's we'll  'S", "<|endoftext|> x", "\x1c\x1d a\x1fb", "日本 한국🎉", "　 x\xa0y\x85z", "a  \nb", "1 2  33\t\t x", "▁a▁▁b", "<s></s><unk><0x0A>", "aaaaaaaaaaaaaaaaaaa", "\x00a", "a" * 500]


def texts() -> list[str]:
    rng = random.Random(2)
    return ODD_TEXTS + ["".join(rng.choice(" abcdetion'rs\n.,é▁中\xa0") for _ in range(rng.randrange(60))) for _ in range(800)]


def test_byte_level_encoding_is_the_librarys():
    from tokenizers import Tokenizer

    own, library = token_files.Encoder(Path(BYTE).read_bytes()), Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    assert own.cuts
    for x in texts():
        assert np.frombuffer(own.encode(x), "<u4").tolist() == library.encode(x, add_special_tokens=False).ids, x
    library.encode_special_tokens = False
    special = token_files.Encoder(Path(BYTE).read_bytes(), special=True)
    assert np.frombuffer(special.encode("a<|endoftext|>b"), "<u4").tolist() == library.encode("a<|endoftext|>b", add_special_tokens=False).ids


def test_op3_against_the_library(spark, sf):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    start = 0
    rows = {r["doc_id"]: r for r in queries.op3_tokens(spark, sf).collect()}
    for r in common.table(spark, sf, "documents").orderBy("doc_id").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        got = rows[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_broken_images_have_nulls_and_fail_no_job(spark):
    good = media.encode_netpbm(np.arange(12, dtype=np.uint8).reshape(3, 4))
    bmp = bytearray(media.encode_bmp(np.zeros((2, 2, 3), np.uint8)))
    bmp[28], bmp[30] = 32, 3  # bit fields, without masks
    bad = [None, b"", b"P5\n99999999999999999999 5\n255\n", b"P6 4294967295 4294967295 255\n", b"P2 1 1 65535 70000", b"P2 1 1 9 10", b"P5\n0 0\n255\n", b"P4 0 3\n", bytes(bmp), b"BM" + b"\xff" * 60, good[:-1], b"GIF89a"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([good, good, *bad])], "doc_id long, image binary")
    got = {r["doc_id"]: r for r in media.tiles(rows, "doc_id", height=2, width=2).collect()}
    assert len(got) == len(bad) + 2 and got[0]["tile"] == got[1]["tile"] is not None and got[0]["width"] == 4
    assert all(got[i]["tile"] is None and got[i]["dhash"] is None for i in range(2, len(bad) + 2))
    assert media.tiles(rows.where("false"), "doc_id").count() == 0


def test_token_files_of_odd_rows(odd, empty, spark, tmp_path):
    for name, frame in (("odd", odd.union(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long")))), ("none", empty)):
        token_files.write_token_files(frame, BYTE, str(tmp_path / name))
    rows = token_files.token_index(spark, str(tmp_path / "odd")).orderBy("start").collect()
    assert len(rows) == 13 and rows[0]["doc_id"] is None and rows[0]["start"] == 0
    for a, b in zip(rows, rows[1:], strict=False):
        assert b["start"] == a["start"] + a["n_tokens"]
    assert token_files.token_index(spark, str(tmp_path / "none")).count() == 0
    assert token_files.read_documents(spark, str(tmp_path / "odd"), [4]).first()["ids"] == [0]


def test_sentencepiece_is_the_librarys():
    import sentencepiece

    own, library = sentencepiece_bpe.Model(Path(PIECE).read_bytes()), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for x in texts():
        ids = library.encode(x)
        assert own.encode(x) == ids and own.decode(ids) == library.decode(ids) and own.digest_parts(x)[1].decode() == library.decode(ids), x


def test_a_token_follows_where_merging_says_so():
    own = sentencepiece_bpe.Model(Path(PIECE).read_bytes())
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefinorst") for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    for w in words:
        assert own.encode_word("▁" + w) == own.merged("▁" + w)


def test_op9_against_the_library(spark, sf):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = {r["doc_id"]: r for r in queries.op9_sentencepiece(spark, sf).collect()}
    for r in common.table(spark, sf, "documents").collect():
        ids = library.encode(r["text"] or "")
        got = rows[r["doc_id"]]
        assert got["n_tokens"] == len(ids) and got["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_encoding_odd_rows(odd, empty):
    assert sentencepiece_bpe.encode(empty, PIECE).count() == 0
    rows = sentencepiece_bpe.encode(odd, PIECE).collect()
    assert len(rows) == 12 and all(r["decoded"] == "" and r["ids"] == [] for r in rows if r["doc_id"] in (3, 4))


def test_images_round_trip():
    rng = np.random.default_rng(0)
    for shape in ((1, 64), (7, 5), (53, 64), (5, 9, 3)):
        x = rng.integers(0, 256, shape).astype(np.uint8)
        for form in (media.encode_netpbm(x), media.encode_bmp(x)):
            assert (media.decode(form) == x).all()
        assert (media.from_npy(media.to_npy(x)) == x).all()
    assert media.decode(b"P2\n# note\n2 2\n255\n1 2\n3 4\n").tolist() == [[1, 2], [3, 4]]
    assert media.decode(b"P1\n2 1\n01").tolist() == [[255, 0]] and media.decode(b"P4 9 1\n\x80\x80").shape == (1, 9)
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    for bad in (b"", b"P9", b"P5 2 2 255\n1", b"BM"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_means_are_exact(monkeypatch):
    x = np.arange(35, dtype=np.uint8).reshape(7, 5)
    fine = np.repeat(np.repeat(x, 8, 0), 9, 1).reshape(8, 7, 9, 5).astype(np.int64)  # boxes of 7 x 5 fine cells
    want = np.repeat(np.repeat(x, 8, 0), 9, 1).reshape(8, 7, 9, 5).sum((1, 3), dtype=np.int64)
    assert (media.area_sums(x, 8, 9) == want).all() and fine.size
    monkeypatch.setattr(media, "STRIP", 3)
    assert (media.area_sums(x, 8, 9) == want).all()
    assert (media.area_resize(np.full((9, 9), 7, np.uint8), 2, 4) == 7).all()


def test_op4_against_brute_force(spark, sf):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in common.table(spark, sf, "documents").collect()}
    for r in queries.op4_media(spark, sf).collect():
        raw = texts[r["doc_id"]]
        data = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(data))
        assert r["payload_sha256"] == hashlib.sha256(data).hexdigest() and r["tail_crc32"] == zlib.crc32(data[-64:])
        tile = media.to_npy(np.frombuffer(data, np.uint8).reshape(-1, 64))
        assert (r["media_bytes"], r["media_sha256"]) == (len(tile), hashlib.sha256(tile).hexdigest()) and len(r["feature"]) == 16


def test_tiles_of_odd_rows(odd, empty, spark, tmp_path):
    media.write_text_tiles(empty, str(tmp_path / "none"))
    assert media.tile_features(spark.read.parquet(str(tmp_path / "none"))).count() == 0
    media.write_text_tiles(odd, str(tmp_path / "odd"))
    rows = media.tile_features(spark.read.parquet(str(tmp_path / "odd"))).collect()
    assert len(rows) == 12 and {r["payload_bytes"] for r in rows if r["doc_id"] in (3, 4)} == {64}
    made = spark.createDataFrame([(1, bytearray(b"P5 2 1 255\n\x01\xff")), (2, bytearray(b"junk")), (3, None)], "id long, image binary")
    out = {r["id"]: r for r in media.tiles(made, "id", height=1, width=2).collect()}
    assert media.from_npy(bytes(out[1]["tile"])).tolist() == [[1, 255]] and out[2]["tile"] is None and out[3]["dhash"] is None


def brute_top(vectors: np.ndarray, ids: np.ndarray, asked: list[int], k: int) -> set[tuple]:
    out = set()
    for q in asked:
        score = vectors @ vectors[ids.tolist().index(q)]
        order = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if i != q)
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(order[:k])}
    return out


def test_op8_against_brute_force(spark, sf):
    rows = common.table(spark, sf, "embeddings").collect()
    ids = np.array([r["vec_id"] for r in rows])
    vectors = np.floor(1024 * np.array([r["embedding"] for r in rows], float)).astype(np.int64)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in queries.op8_mtree(spark, sf).collect()}
    assert got == brute_top(vectors, ids, [i for i in ids.tolist() if i % 100 == 0], 10)


def test_trees_leave_pages_out_and_keep_ties():
    rng = np.random.default_rng(1)
    centres = rng.integers(-900, 900, (12, 16))
    vectors = centres[rng.integers(12, size=3000)] + rng.integers(-20, 20, (3000, 16))
    vectors[100:300] = vectors[5]
    tree = mtree.MTree(vectors, int((vectors**2).sum(1).max()), page=32)
    for q in vectors[:40]:
        scores = vectors @ q
        best = np.sort(scores)[::-1][9]
        assert sorted(tree.search(q, 10)) == sorted((int(s), int(i)) for i, s in enumerate(scores) if s >= best)
    assert tree.computed < 40 * 3000 * 0.6


def test_search_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [-1.0]), (None, [1.0, 1.0]), (1, [1.0, 2.0]), (0, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", mtree.quantized(F.col("embedding")).alias("vector"))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in mtree.exact_top(frame, frame.where("vec_id % 100 = 0"), 10).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 1), (0, 3, 6)]
    assert mtree.exact_top(frame.where("false"), frame, 3).count() == 0 and mtree.exact_top(frame, frame.where("false"), 3).count() == 0


@pytest.mark.parametrize("largest", [9, 10**8, 4 * 10**8])
def test_search_over_many_cells_against_brute_force(spark, largest):
    rng = np.random.default_rng(2)
    centres = rng.integers(-largest, largest, (9, 12))
    vectors = centres[rng.integers(9, size=900)] + rng.integers(-largest // 9, largest // 9 + 1, (900, 12))
    vectors[50:90] = vectors[3]
    rows = [(i, [int(x) for x in v]) for i, v in enumerate(vectors.tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<long>")
    found = mtree.exact_top(frame, frame.where("vec_id % 20 = 0"), 7, tree=100, block=16)
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()}
    want = set()
    for q in range(0, 900, 20):
        scores = sorted((-sum(a * b for a, b in zip(rows[q][1], v, strict=True)), i) for i, v in rows if i != q)
        want |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:7])}
    assert got == want


def test_cells_that_hold_nothing_better_are_left_out():
    rng = np.random.default_rng(3)
    centres = rng.integers(-1000, 1000, (30, 8))
    vectors = centres[rng.integers(30, size=3000)] + rng.integers(-9, 9, (3000, 8))
    cells = mtree.Cells(centres, int((vectors**2).sum(1).max()))
    cell, distance = cells.nearest(vectors)
    for c in range(30):
        cells.radius[c] = distance[cell == c].max(initial=0)
    q = vectors[:50]
    scores = np.sort(q @ vectors.T, 1)[:, -10]
    wanted = cells.least(q) <= cells.reach(q, scores)[:, None]
    assert wanted.mean() < 0.5
    for i in range(50):
        assert wanted[i, cell[q[i] @ vectors.T >= scores[i]]].all()


def test_vectors_whose_scores_do_not_fit_are_refused(spark):
    frame = spark.createDataFrame([(0, [4 * 10**9]), (1, [1])], "vec_id long, vector array<long>")
    with pytest.raises(ValueError, match="64 bits"):
        mtree.exact_top(frame, frame, 1)


END = "<|endoftext|>"
WITH_ADDED = [f"a {END} b", END, END * 3, f"{END}\n", f"a  {END}  b", f"x\n\n{END}\n\ny", f"<|endoftext|{END}|>", f"it's{END}'s", f"\u65e5\u672c{END}\ud55c\u56fd", "<|endoftext| >"]


def test_added_tokens_are_found_as_the_library_finds_them():
    from tokenizers import Tokenizer

    own, library = token_files.Encoder(Path(BYTE).read_bytes(), special=True), Tokenizer.from_file(BYTE)
    rng = random.Random(5)
    mixed = ["".join(rng.choice([END, " ", "  ", "a", "the", "\n", "'s", "<|", "1", "\u4e2d", "\xa0"]) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    assert own.cuts
    for x in [*texts(), *WITH_ADDED, *mixed]:
        assert np.frombuffer(own.encode(x), "<u4").tolist() == library.encode(x, add_special_tokens=False).ids, x


def test_op3_of_texts_with_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTE)
    spark.createDataFrame(list(enumerate(WITH_ADDED)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows, start = {r["doc_id"]: r for r in queries.op3_tokens(spark, str(tmp_path)).collect()}, 0
    for i, x in enumerate(WITH_ADDED):
        ids = [*library.encode(x, add_special_tokens=False).ids, 0]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_texts_split_at_single_spaces_are_encoded_as_whole_ones(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "MOST_CHUNKS", 40)
    rng, white = random.Random(51), ["\n", "\t", "\r", "\u00a0", "\u2003", "\u3000", "\x85", "\x1c", "\u200b"]
    own, library = token_files.Encoder(Path(BYTE).read_bytes(), special=True), Tokenizer.from_file(BYTE)
    pieces = ["word", "don't", "x1y2", "\u00e9t\u00e9!", "\u4e2d\u6587", "...", "A.B", "'s", "end.\nNext", "\u01c5\u0250", *white]
    for k in range(600):
        gaps = [" "] if k % 3 else [" ", " ", "  ", "   ", "", *white]
        text = "".join(rng.choice(pieces[:10] if k % 2 else pieces) + rng.choice(gaps) for _ in range(rng.randrange(12)))
        text = rng.choice(["", " ", "\n"]) + (text if k % 5 else text.rstrip())
        for _ in range(2):
            assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    assert len(own.spaced) <= 40 and "word" in own.spaced | own.spaced.before

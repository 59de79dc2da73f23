"""SimHash near-duplicates and repeated substrings."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import common, queries, simhash, stages, suffix


def brute_print(text: str | None) -> int:
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[int], ids: list[int], most: int = 4) -> list[int]:
    fp, parent = np.array(prints, np.uint64), list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= most).tolist():
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, one in enumerate(ids):
        least[root(i)] = min(least.get(root(i), one), one)
    return [least[root(i)] for i in range(len(ids))]


def test_op7_against_brute_force(spark, sf):
    docs = common.table(spark, sf, "documents").orderBy("doc_id").collect()
    rows = {r["doc_id"]: r for r in queries.op7_simhash(spark, sf).collect()}
    prints, ids = [brute_print(r["text"]) for r in docs], [r["doc_id"] for r in docs]
    assert [rows[i]["fingerprint"] for i in ids] == [f"{p:016x}" for p in prints]
    assert [rows[i]["component_id"] for i in ids] == brute_components(prints, ids)


def test_every_link_within_four_bits_is_found():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(1, 7))) for b in base for _ in range(4)]
    prints = list(dict.fromkeys([*base, *near]))
    low, links = 8, []
    for bucket in range(1 << low):
        own = [p for p in prints if ((p ^ bucket) & 255).bit_count() <= 2]
        links += [x[:2] for x in simhash.bucket_links(np.array(own, np.uint64), bucket, low)]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    want = brute_components(prints, prints)
    groups: dict[int, set[int]] = {}
    for p, w in zip(prints, want, strict=True):
        groups.setdefault(w, set()).add(root(p))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_ball_in_parts_finds_the_same(monkeypatch):
    rng = random.Random(6)
    prints = np.array([0xAA00 ^ (1 << rng.randrange(8, 64)) ^ (1 << rng.randrange(8, 64)) for _ in range(40)], np.uint64)
    whole, stars = simhash.bucket_links(prints, 0, 8), simhash.bucket_links(prints, 0, 8, forest=False)
    for most in (3000, 100, 1):
        monkeypatch.setattr(simhash, "AT_ONCE", most)
        assert len(simhash.bucket_links(prints, 0, 8)) == len(whole) == len(np.unique(prints)) - 1
        assert sorted(simhash.bucket_links(prints, 0, 8, forest=False)) == sorted(stars)


def test_full_buckets_are_dealt_out_by_more_bits(spark):
    rng = random.Random(15)
    prints = [rng.getrandbits(20) << 44 | (rng.getrandbits(3) << 30) for _ in range(150)]
    rows = spark.createDataFrame([(t, p - (1 << 64) if p >> 63 else p) for t in (0, 1) for p in prints], "tag long, fingerprint long")
    want = brute_components(prints, prints)
    for most in (10**6, 20, 1):
        links = [r for r in simhash.near_links(rows, most=most).collect()]
        for tag in (0, 1):
            parent = {p: p for p in prints}
            for r in links:
                if r["tag"] == tag:
                    a, b = r["a"] % (1 << 64), r["b"] % (1 << 64)
                    assert (a ^ b).bit_count() <= 4
                    old, new = max(parent[a], parent[b]), min(parent[a], parent[b])
                    parent = {p: new if x == old else x for p, x in parent.items()}
            assert [parent[p] for p in prints] == want


def test_components_of_long_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(40)]
    hub = [(1000, 1000 + i) for i in range(1, 60)]
    found = {r["node"]: r["root"] for r in common.components(spark.createDataFrame([*path, *hub, (7, 7)], "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[1000 + i] for i in range(60)} == {1000}


def test_near_duplicates_of_odd_rows(odd, with_clashes, empty):
    assert simhash.near_duplicates(empty).count() == 0
    rows = [tuple(r) for r in simhash.near_duplicates(with_clashes).collect()]
    comp = {r[0]: r[2] for r in rows}
    assert len(rows) == 12 and comp[1] == comp[2] == 1 and comp[3] == comp[4] == comp[5] == 3
    kept = simhash.keep_one(with_clashes)
    assert kept.columns == with_clashes.columns and simhash.keep_one(empty).count() == 0
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 6, 7, 8, 9, 10, 11]


def brute_removed(rows: list[tuple[int, str | None]], window: int = 100) -> dict[int, tuple]:
    seen, out = set(), {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            s = raw[p : p + window]
            if s in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = sum(1 for k in range(len(gone)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(raw), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def found(frame) -> dict[int, tuple]:
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in frame.collect()}


def test_op6_against_brute_force(spark, sf):
    docs = common.table(spark, sf, "documents").select("doc_id", "text").collect()
    assert found(queries.op6_suffix(spark, sf)) == brute_removed([tuple(r) for r in docs])


def assert_spans(spark, rows: list[tuple[int, str | None]], most: int) -> None:
    spans = {r["doc"]: np.array(r["spans"]) for r in suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()}
    for (i, text), (n, gone, runs, digest) in zip(sorted(rows), brute_removed(rows).values(), strict=True):
        raw = (text or "").encode()
        merged = suffix.merged(spans.get(i, np.zeros(0, np.int64)), n)
        assert (sum(z - a for a, z in merged), len(merged), hashlib.sha256(suffix.without(raw, merged)).hexdigest()) == (gone, runs, digest)


@pytest.mark.parametrize("most", [4096, 4, 1])
def test_repeats_of_every_kind(spark, most):
    rng = random.Random(3)
    common_line = "".join(rng.choices("abcde ", k=130))
    rows = [(i, "".join(rng.choices("abcdefgh", k=rng.randrange(200))) + common_line[: rng.randrange(95, 131)] + "".join(rng.choices("xyz", k=60))) for i in range(40)]
    rows += [(100, "a" * 700), (101, "ab" * 200 + "a" * 150), (102, None), (103, ""), (104, "é" * 120), (105, "x" + "é" * 120), (106, "short")]
    assert_spans(spark, rows, most)


def test_thousands_of_contexts_on_one_gram(spark):
    rng = random.Random(4)
    line = "".join(rng.choices("abcdefghij ", k=110))
    rows = [(i, "".join(rng.choices("abcdefghij ", k=150)) + line + "".join(rng.choices("abcdefghij ", k=150))) for i in range(5000)]
    rows += [(5000 + i, rows[i][1][:300] + "end") for i in range(300)]
    assert_spans(spark, rows, suffix.SHARD_CONTEXTS)
    assert_spans(spark, rows[-1500:], 60)


@pytest.mark.parametrize("window, gram", [(10, 4), (20, 8)])
def test_dealing_on_keeps_equal_windows_together(window, gram):
    rng = random.Random(8)
    for _ in range(60):
        base = [rng.choices(b"ab", k=rng.randrange(80)) for _ in range(4)]
        docs = [bytes(rng.choice(base) + rng.choice(base)) for _ in range(rng.randrange(1, 25))]
        rows, want, seen = [], set(), set()
        for g in suffix.segments(docs, window):
            grams, _, which, at, gap, count = suffix.anchors(g, window, gram)
            rows += [(g, 0, o, a, k, docs[o][a - k : a - k + n + window - 1]) for g, o, a, k, n in zip(grams.view(np.int64).tolist(), which.tolist(), at.tolist(), gap.tolist(), count.tolist(), strict=True)]
        for o, text in enumerate(docs):
            for i in range(len(text) - window + 1):
                (want.add((o, i)) if text[i : i + window] in seen else seen.add(text[i : i + window]))
        got, level = set(), rows
        while level:
            groups: dict[int, list] = {}
            for r in level:
                groups.setdefault(r[0], []).append(r)
            pairs = [(*r, *min(own, key=lambda x: x[1:4])[1:]) for own in groups.values() for r in own]
            batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*pairs, strict=True)], [str(i) for i in range(11)])
            made = [r for b in suffix._deal_on(window)(iter([batch])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            got |= {(o, a + i) for _, _, o, a, n, text in made if text is None for i in range(n - window + 1)}
            level = [r for r in made if r[5] is not None]
        assert got == want


def test_long_texts_are_cut_into_overlapping_segments(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(suffix, "CHUNK", 400)
    text = bytes(rng.randrange(97, 123) for _ in range(1500))
    covered = set()
    for group in suffix.segments([text]):
        _, _, _, at, gap, n = suffix.anchors(group)
        for a, k in zip((at - gap).tolist(), n.tolist(), strict=True):
            new = set(range(a, a + k))
            assert not new & covered
            covered |= new
    assert covered == set(range(1500 - 99))


@pytest.mark.parametrize("buckets", [8192, 3, 1])
def test_suffix_array_and_prefixes(monkeypatch, buckets):
    rng = random.Random(2)
    monkeypatch.setattr(suffix, "BUCKETS", buckets)
    for _ in range(150):
        strings = [bytes(rng.randrange(rng.choice([1, 2, 30])) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 4))]
        s = b"\xff".join(strings) + b"\xff"
        sa = suffix.suffix_array(np.frombuffer(s, np.uint8))
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        room = np.array([s.index(b"\xff", i) - i for i in range(len(s))])
        lcp = suffix.common_prefixes(s, sa, room)
        for a, b in zip(sa.tolist(), sa[1:].tolist(), strict=False):
            n = 0
            while n < min(room[a], room[b]) and s[a + n] == s[b + n]:
                n += 1
            assert lcp[b] == n


def test_suffix_array_of_large_numbers():
    rng = random.Random(7)
    for most in (3, 1000, 1 << 20):
        s = [rng.randrange(most) for _ in range(700)]
        assert suffix.suffix_array(np.array(s)).tolist() == sorted(range(700), key=lambda i: s[i:])


def test_removal_from_odd_rows(odd, with_clashes, empty):
    assert suffix.removal_report(empty).count() == 0 and suffix.remove_repeats(empty).count() == 0
    rows = {r["doc_id"]: r for r in suffix.remove_repeats(odd).collect()}
    assert 2 not in rows and rows[3]["text"] is None and rows[4]["text"] == "" and len(rows[10]["text"]) < 110
    assert rows[9]["text"].startswith("Other start.") and len(rows[9]["text"]) < 40
    assert suffix.remove_repeats(with_clashes).columns == with_clashes.columns
    assert suffix.removal_report(odd).count() == 12


def test_rows_without_ids_or_with_repeated_ones_are_documents_of_their_own(spark):
    rng = random.Random(9)
    shared, *own = ("".join(rng.choices("abcdefghij ", k=279)) for _ in range(6))
    texts = [(None, own[0] + shared), (None, shared + own[1]), (None, own[2]), (2, own[3] + shared), (2, own[4]), (3, own[2]), (4, own[4] + own[3])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    hashes = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    ordered = sorted(texts, key=lambda r: (r[0] or -1, hashes[r[1]]))
    want = brute_removed([(i, t) for i, (_, t) in enumerate(ordered)])
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.removal_report(docs).collect())
    assert got == sorted((k or -1, *want[i]) for i, (k, _) in enumerate(ordered))
    left = [r["text"] for r in suffix.remove_repeats(docs).collect()]
    assert sum(len(t) for t in left) == sum(w[0] - w[1] for w in want.values()) and all(any(x in t for t in left) for x in own)
    twice = suffix.removal_report(docs.union(docs)).collect()
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in twice) == sorted(2 * got)


def test_keys_that_are_no_numbers_are_keys(spark):
    rows = [("a", "x" * 99 + "yz" * 60), ("b", "other " * 30), ("c", "x" * 99 + "yz" * 60)]
    report = suffix.removal_report(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r["doc_id"] for r in report} == {"a", "b", "c"} and next(r for r in report if r["doc_id"] == "b")["n_removed"] > 0


def test_only_whole_characters_are_cut():
    raw = "aéé".encode()
    assert suffix.whole_characters(raw, [(2, 4)]) == [] and suffix.whole_characters(raw, [(1, 4)]) == [(1, 3)] and suffix.whole_characters(raw, [(2, 5)]) == [(3, 5)]


def periodic_rows() -> list[tuple[int, str]]:
    """Texts of one word over and over, with a typo here and there."""
    rng, rows = random.Random(11), []
    for i in range(30):
        text = list(("banana " * 220)[:1500])
        for p in rng.sample(range(1500), 9):
            text[p] = rng.choice("bnaxyz ")
        rows.append((i, "".join(text)))
    return rows


@pytest.mark.parametrize("most", [100_000, 128])
def test_periodic_texts_with_typos(spark, most):
    assert_spans(spark, periodic_rows(), most)


def brute_similar(texts: list[str | None], ids: list[int]) -> list[int]:
    """Smallest id of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 at least."""
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least: dict[int, int] = {}
    for i, one in enumerate(ids):
        least[root(i)] = min(least.get(root(i), one), one)
    return [least[root(i)] for i in range(len(ids))]


def test_near_stage_finds_copies_with_edited_words(spark, sf):
    rng = random.Random(21)
    rows = [(r["doc_id"], r["text"]) for r in common.table(spark, sf, "documents").collect()]
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3000)]
    for g in range(25):
        base = rng.choices(words, k=300)
        for c in range(4):
            copy = list(base)
            for p in rng.sample(range(300), 2 * c + (g % 2)):
                copy[p] = rng.choice(words)
            rows.append((100_000 + 10 * g + c, " ".join(copy)))
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in stages.near_duplicates(spark, docs, sf).collect())
    assert got == sorted(set(brute_similar([t for _, t in rows], [i for i, _ in rows])))


def test_similarity_is_exact_at_its_bound():
    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)
    assert simhash.similar(a, b) and not simhash.similar(a[:8], b[:8]) and simhash.similar(a[:0], a[:0])
    one = simhash.shingle_set
    assert one(b"A b  c\nd e").tolist() == one(b"a b c d e").tolist() and len(one(b"a b c d e f")) == 2 and len(one(b"a")) == 1 and one(b"a") != one(b"a a")


def test_words_are_hashed_alike_in_chunks(monkeypatch):
    rng = random.Random(17)
    for _ in range(80):
        text = "".join(rng.choice(["a", "B", "é", " ", "\t", "\n ", "w" * 25]) for _ in range(rng.randrange(120))).encode()
        words = text.lower().split()
        whole = simhash.word_hashes(text)
        assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words))
        assert all(simhash.word_hashes(w).tolist() == [h] for w, h in zip(words, whole.tolist(), strict=True))
        with monkeypatch.context() as m:
            m.setattr(simhash, "CHUNK", 16)
            assert simhash.word_hashes(text).tolist() == whole.tolist()


def test_table_prints_are_majorities():
    made = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 9000, np.uint64))
    words = simhash._mix((made[:, None] ^ simhash._MASKS) * simhash._FACTORS)
    bits = [(sum(int(w) >> b & 1 for w in words[:, k].tolist()) * 2 > len(made)) for k in range(words.shape[1]) for b in range(64)]
    want = [sum(1 << i for i in range(40) if bits[t * 40 + i]) for t in range(simhash.TABLES)]
    assert simhash.table_prints(made).tolist() == want and not simhash.table_prints(made[:0]).any()


def test_rows_without_ids_or_with_repeated_ones_are_kept_by_component(spark):
    rng = random.Random(31)
    a, b, c, d = (" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(60)) for _ in range(4))
    rows = [(None, a), (None, b), (None, a), (5, c), (5, d), (5, c), (7, d), (8, a)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == sorted([(8, a), (0, b), (5, c), (5, d)])


def cloud_of_copies(n: int) -> list[str]:
    """Near copies of one text, with one to a dozen words edited, so that some are similar to others and many aren't."""
    rng = random.Random(41)
    base = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(150)]
    out = []
    for i in range(n):
        copy = list(base)
        for p in rng.sample(range(150), 1 + i % 12):
            copy[p] = f"w{rng.randrange(10**9)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("group", [1000, 90])
def test_cloud_of_near_copies_costs_few_pairs_and_loses_none(spark, monkeypatch, group):
    texts = cloud_of_copies(400)
    counts, links, verified = {}, simhash.near_links, simhash._verified

    def counted(name, run):
        def one(*args, **kwargs):
            out = run(*args, **kwargs)
            counts[name] = counts.get(name, 0) + (args[0] if name == "pairs" else out).count()
            return out

        return one

    monkeypatch.setattr(simhash, "near_links", counted("links", links))
    monkeypatch.setattr(simhash, "_verified", counted("pairs", verified))
    monkeypatch.setattr(simhash, "GROUP", group, raising=False)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["own"]: r["root"] for r in simhash.similar_texts(docs, "doc_id").collect()}
    want = brute_similar(texts, list(range(400)))
    assert len({(got[i], want[i]) for i in got}) == len(set(got.values())) == len(set(want))
    assert counts["links"] <= 400 * simhash.TABLES * 11 * 5 and counts["pairs"] <= 400 * 10


def test_links_of_a_cloud_are_gathered_before_its_components(spark, monkeypatch):
    given, found = [], simhash.components

    def counted(edges):
        given.append(edges.count())
        return found(edges)

    monkeypatch.setattr(simhash, "components", counted)
    docs = spark.createDataFrame(list(enumerate(cloud_of_copies(400))), "doc_id long, text string")
    assert simhash.similar_texts(docs, "doc_id").count() == 400
    assert len(given) == 2 and given[0] <= 400 * 4


@pytest.mark.parametrize("group", [1000, 40, 7])
def test_groups_of_a_cloud_lose_no_link_and_repeat_few(spark, monkeypatch, group):
    rng = random.Random(61)
    bases = [["".join(rng.choices("abcdefghij", k=6)) for _ in range(60)] for _ in range(12)]
    texts = [*cloud_of_copies(150), "", " ", "\n", "one", "One ", "one two", *("x " * n for n in range(4, 9))]
    for i in range(130):
        copy = bases[i % 12][:]
        for p in rng.sample(range(60), i % 4):
            copy[p] = rng.choice("ab")
        texts.append(" ".join(copy))
    texts += [" ".join(bases[0][: 60 - k] + bases[1][:k]) for k in range(0, 61, 3)]
    monkeypatch.setattr(simhash, "GROUP", group)
    rows = [(i // 1000, i, len(simhash.shingle_set(t.encode())), t) for i, t in enumerate(texts)]
    made = spark.createDataFrame(rows, "cloud long, node long, size long, text string").cache()
    links = [(r["a"], r["b"]) for r in simhash._cloud_links(made.drop("text"), made.select("node", "text"), 80).collect()]
    want = brute_similar(texts, list(range(len(texts))))
    groups = [set(g) for g in linked_groups([(a, b, 0) for a, b in links])]
    assert sorted(map(sorted, groups)) == sorted(sorted(i for i, w in enumerate(want) if w == x) for x in set(want) if want.count(x) > 1)
    assert len(links) <= 2 * len(texts)


def test_gathered_links_connect_what_stars_do(spark):
    rng = random.Random(51)
    stars = list({(rng.randrange(900), rng.randrange(60) * 15 + 900 * (i % 3)) for i in range(1500)})
    rows = [(a, b) for a, b in stars if a != b]
    few = [(r["a"], r["b"], 0) for r in simhash._gathered(spark.createDataFrame(rows, "a long, b long")).collect()]
    whole = linked_groups([(a, b, 0) for a, b in rows])
    assert sorted(map(sorted, linked_groups(few))) == sorted(map(sorted, whole)) and len(few) < len(rows)


def test_dense_links_keep_what_is_connected():
    rng = np.random.default_rng(5)
    prints = np.unique(np.concatenate([[sum(1 << int(b) for b in rng.choice(40, 2, replace=False)) for _ in range(500)], rng.integers(0, 1 << 40, 500)]).astype(np.uint64))
    whole, few = simhash.bucket_links(prints, 0, 0, 40, forest=False), simhash.bucket_links(prints, 0, 0, 40, forest=False, dense=4)
    parts = lambda links: {x: frozenset(c) for c in linked_groups(links) for x in c}
    assert parts(whole) == parts(few) and len(few) <= 3 * len(prints) < len(whole)
    assert {x for x in few if x[2]} <= set(whole)


def linked_groups(links: list[tuple[int, int, int]]) -> list[set[int]]:
    groups: list[set[int]] = []
    for a, b, _ in links:
        own = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in own] + [set().union({a, b}, *own)]
    return groups


def test_similar_sets_are_those_of_all_pairs():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 60, 9000, np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base[: int(n)], int(n * rng.uniform(0.8, 1)), replace=False), rng.integers(0, 1 << 60, int(rng.integers(1, 9)), np.uint64)])) for n in rng.choice([12, 40, 9000], 60)]
    sets += [np.zeros(0, np.uint64)] * 2 + [base[:0]]
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if simhash.similar(sets[i], sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if x in (a, b) else x for x in parent]
    assert simhash.similar_sets(sets).tolist() == parent and simhash.similar_sets([]).tolist() == []

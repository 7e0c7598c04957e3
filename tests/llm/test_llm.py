"""The llm operators against brute force on small fixtures, and their edge cases."""

import io
import random
import re
import struct
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loam.llm import bpe, decontamination, html, jaccard, language_model, media, quality, repeats, sharding, toxicity

SCHEMA = "doc_id long, text string, n_chars long, lang string"


def _text(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(i, _text(rng, rng.randrange(1, 160), 60 if i % 2 else 4000)) for i in range(60)]
    passage = _text(rng, 60, 5000)
    for i in range(60, 100):
        base = rows[rng.randrange(60)][1].split()
        for _ in range(rng.randrange(0, 4)):
            base[rng.randrange(len(base))] = "edited"
        rows.append((i, " ".join(base) + (" " + passage if i % 3 == 0 else "")))
    rows += [(100, None), (101, ""), (102, " \n\t "), (None, rows[0][1]), (5, rows[7][1]), (103, "word " * 30_000), rows[3], rows[3], (104, rows[9][1])]
    return spark.createDataFrame([(i, t, None if t is None else len(t), None) for i, t in rows], SCHEMA)


def _grams(text):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return {tuple(w)} - {()} if len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def _pairs(docs, threshold=jaccard.THRESHOLD):
    rows = [(r.doc_id, _grams(r.text)) for r in docs.collect() if r.doc_id is not None]
    best = {}
    for (i, a), (j, b) in combinations([(i, s) for i, s in rows if s], 2):
        value = len(a & b) / len(a | b)
        if i != j and value >= threshold:
            best[min(i, j), max(i, j)] = max(value, best.get((min(i, j), max(i, j)), 0))
    return best


def test_jaccard_is_exact(docs):
    want = _pairs(docs)
    got = {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.join(docs).collect()}
    assert len(want) > 20
    assert got == pytest.approx(want)


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_signatures_meet(threshold):
    """Similar sets share a signature even if all n-grams count as frequent."""
    rng = np.random.default_rng(1)
    prefixes = jaccard.Prefixes(np.zeros(1 << 16, np.uint8), threshold)
    for frequent in (False, True):
        prefixes.grades[:] = 2 | (jaccard._FREQUENT if frequent else 0)
        for n in (1, 2, 3, 7, 20, 60, 300):
            for _ in range(20):
                a = np.unique(rng.integers(0, 1 << 58, n).astype(np.uint64))
                drop = int(len(a) * (1 - threshold))
                b = np.sort(rng.permutation(a)[: len(a) - drop])
                h, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
                sig, row, _ = prefixes.signatures(h, first)
                if len(b) / len(a) >= threshold:
                    assert set(sig[row == 0]) & set(sig[row == 1])


def _classes(docs):
    """(class_id, links) by doc_id, by brute force over records, that is, distinct pairs of doc_id and set."""
    records = sorted({(r.doc_id, frozenset(_grams(r.text))) for r in docs.collect() if r.doc_id is not None and _grams(r.text)}, key=lambda x: (x[0], len(x[1])))
    links, parent = {}, {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in combinations(records, 2):
        if len(a & b) >= jaccard.THRESHOLD * len(a | b):
            links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
            x, y = top(i), top(j)
            parent[max(x, y)] = min(x, y)
    return {i: (top(i), n) for i, n in links.items()}


def _got(docs):
    return {r.doc_id: (r.class_id, r.links) for r in jaccard.classes(docs).collect()}


def test_classes_are_exact(docs):
    want = _classes(docs)
    assert len(want) > 20
    assert _got(docs) == want


@pytest.fixture(scope="module")
def copies(spark):
    """A large group of near copies, some of them equal, a chain of neighbours, and texts that share a passage."""
    rng = random.Random(12)
    base, passage = _text(rng, 120, 3000).split(), _text(rng, 55, 6000)
    rows = []
    for i in range(150):
        own = list(base)
        for _ in range(rng.randrange(0, 7)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(own)))
    chain = [f"c{k}" for k in range(200)]
    rows += [(200 + k, " ".join(chain[8 * k : 8 * k + 60])) for k in range(17)]
    rows += [(300 + k, _text(rng, 150, 5000) + " " + passage) for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("block", [1_000_000, 3000])
def test_classes_of_copies(copies, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    want = _classes(copies)
    assert max(n for _, n in want.values()) > 50
    assert _got(copies) == want


@pytest.mark.parametrize("tile, columns", [(512, 8192), (7, 5)])
def test_tiles(monkeypatch, tile, columns):
    monkeypatch.setattr(jaccard, "_TILE", tile)
    monkeypatch.setattr(jaccard, "_COLUMNS", columns)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 25))).astype(np.uint64) for _ in range(40)]
    for left, right in ((every := np.arange(40), every), (np.arange(0, 40, 2), np.arange(1, 40, 2)), (np.arange(40), np.arange(0))):
        got = {(int(a), int(b)): v for x in jaccard.similar(sets, left, right, 0.5) for a, b, v in zip(*x)}
        pairs = combinations(range(40), 2) if len(left) == len(right) == 40 else [(int(a), int(b)) for a in left for b in right]
        value = {(a, b): len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) for a, b in pairs}
        assert got == pytest.approx({k: v for k, v in value.items() if v >= 0.5})


def test_pairs_of_copies(copies):
    assert {(r.doc_a, r.doc_b): r.jaccard for r in jaccard.join(copies).collect()} == pytest.approx(_pairs(copies))


def test_frequent_classes(copies, monkeypatch):
    """Results stay when every n-gram counts as frequent, so that only combinations are indexed."""
    monkeypatch.setattr(jaccard, "RARE", -1)
    assert _got(copies) == _classes(copies)


def test_jaccard_other_columns(copies):
    odd = copies.selectExpr("*", "doc_id AS id", "text AS label", "1 AS part", "2 AS `a.b`", "map('k', 1) AS x")
    assert _got(odd) == _classes(copies)


@pytest.mark.parametrize("mean", [3, 200])
def test_sketch_gaps(mean):
    values = np.sort(np.random.default_rng(1).integers(0, 1000 * mean, 1000))
    assert np.array_equal(jaccard._ungap(jaccard._gaps(values)), values)
    assert len(jaccard._ungap(jaccard._gaps(values[:0]))) == 0


def test_jaccard_empty(docs):
    assert jaccard.join(docs.limit(0)).count() == 0
    assert jaccard.classes(docs.limit(0)).count() == 0
    assert jaccard.classes(docs.where("doc_id IS NULL OR text = ''")).count() == 0


def _windows(rows):
    seen, want = {}, set()
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - repeats.WORDS + 1):
            key = tuple(w[p : p + repeats.WORDS])
            if key in seen:
                want.add((i, p, *seen[key]))
            else:
                seen[key] = (i, p)
    return want


def _uid(spark, texts):
    """The text hash by which rows of one doc_id are ordered."""
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.xxhash64("text").alias("uid")).collect()
    return {r.text: r.uid for r in rows}


def _covered(found):
    return {(r.doc_id, p, r.first_doc, r.first_word + p - r.start_word) for r in found for p in range(r.start_word, r.end_word - repeats.WORDS + 1)}


def test_repeats_are_exact(spark, docs):
    """Rows without doc_id come last, those of one doc_id by the hash of their text, repeated rows count as one."""
    texts = {r.text for r in docs.collect() if r.text}
    uid = _uid(spark, texts)
    rows = sorted({(r.doc_id, r.text) for r in docs.collect() if r.text}, key=lambda x: (x[0] is None, x[0] or 0, uid[x[1]]))
    assert sum(i == 5 for i, _ in rows) == 2 and rows[-1][0] is None
    assert _covered(repeats.dedup_spans(docs).collect()) == _windows(rows)


@pytest.mark.parametrize("held", [16 << 20, 20_000])
def test_repeats_of_many_copies(spark, monkeypatch, held):
    """Many equal texts, texts that share a part of them, equal passages in different places."""
    rng = random.Random(21)
    base = _text(rng, 150, 4000)
    other = " ".join(base.split()[20:110])
    rows = [(k, base) for k in range(1, 40)] + [(k, f"{_text(rng, k % 7, 4000)} {other} {_text(rng, 30, 4000)}".strip()) for k in range(40, 60)] + [(None, base), (3, other), (0, "x " + other), (61, base + " " + base)]
    rows += [rows[5], rows[5], (None, base)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    uid = _uid(spark, {t for _, t in rows})
    want = _windows(sorted(set(rows), key=lambda x: (x[0] is None, x[0] or 0, uid[x[1]])))
    assert len(want) > 4000
    assert _covered(repeats.dedup_spans(docs).collect()) == want


def test_repeats_empty(spark, docs):
    assert repeats.dedup_spans(docs.limit(0)).count() == 0 and repeats.cut(docs.limit(0)).count() == 0
    assert repeats.dedup_spans(docs.where("text IS NULL OR text = ''")).count() == 0


def test_cut_columns(spark):
    rng = random.Random(22)
    passage = _text(rng, 60, 900)
    rows = [(1, passage + " a", 1, "x"), (2, "b " + passage, 2, "y"), (2, "b " + passage, 2, "y"), (None, None, 3, "z"), (None, "", 4, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` int, _spans string").withColumn("uid", F.lit(7))
    left = repeats.cut(docs)
    assert left.columns == docs.columns
    want = [(1, passage + " a", 1, "x", 7), (2, "b ", 2, "y", 7), (2, "b ", 2, "y", 7), (None, None, 3, "z", 7), (None, "", 4, "z", 7)]
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(want, key=repr)


def test_colliding_words():
    w = repeats.words(pa.array(["one two one three two a_word_of_many_letters a_word_of_more_letters"]), False)
    w.hash[[0, 1, 2, 4]] = 7
    w.hash[5:] = 9
    t = repeats.tokens_of(w.data, w).tolist()
    assert t[0] == t[2] and t[1] == t[4] and len(set(t)) == 5 and w.hash[0] == 7


def test_colliding_runs(monkeypatch):
    """A hash that is the same for all runs is found out and replaced."""
    rng = np.random.default_rng(3)
    body = " ".join(f"w{k}" for k in rng.integers(0, 500, 60))
    texts = pa.array([body, " ".join(f"w{k}" for k in rng.integers(0, 500, 60)), body])
    args = (texts, np.ones(3, np.uint64), np.full(3, 5), np.full(3, 11), np.arange(3), np.arange(3), np.zeros(3, np.int64))
    want = repeats.repeats(*args)
    made = []

    class Poor(repeats.Suffixes):
        def __init__(self, tokens):
            super().__init__(tokens)
            made.append(self)
            if len(made) == 1:
                self.sums = np.zeros_like(self.sums)

    monkeypatch.setattr(repeats, "Suffixes", Poor)
    got = repeats.repeats(*args)
    assert len(made) == 2 and len(want[0]) == 11 and all(np.array_equal(np.sort(a), np.sort(b)) for a, b in zip(got, want))


def test_cut_leaves_one_copy(spark):
    rng = random.Random(5)
    passage = _text(rng, 70, 9000)
    rows = [(1, "a b " + passage + " c", None), (2, "é  d " + passage + "\n e", 9), (3, passage, 9), (4, None, 9), (None, passage, 9)]
    left = {r.doc_id: r.text for r in repeats.cut(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert left == {1: rows[0][1], 2: "é  d e", 4: None}


def test_suffix_sort():
    rng = np.random.default_rng(2)
    tokens = rng.integers(0, 2, 400).astype(np.uint64)
    start = np.arange(300)
    group = np.sort(rng.integers(0, 3, 300))
    order = repeats.Suffixes(tokens).sort(start, group)
    want = sorted(range(300), key=lambda i: (group[i], tokens[i : i + repeats.WORDS].tolist(), i))
    assert order.tolist() == want


def test_sharding(docs):
    got = sharding.assign(docs, shards=7).collect()
    n = docs.count()
    assert sorted(r.row_no for r in got) == list(range(n))
    assert len({(r.shard, r.slot) for r in got}) == n
    assert all(sharding.source_row(r.shard, r.slot, n, 7) == r.row_no and sharding.place(r.row_no, n, 7) == (r.shard, r.slot) for r in got)
    assert got and sharding.assign(docs.limit(0)).count() == 0


def test_sharding_rows(spark):
    """Repeated rows, NULL keys, columns with names of the operator's own, maps."""
    rows = [(None, 1, {"a": 1}, "x"), (None, 1, {"a": 2}, "x"), *[(5, 7, {"b": 1}, "y")] * 40, (3, 2, None, None), *[(5, 8, {"b": 1}, "y")] * 3]
    docs = spark.createDataFrame(rows, "doc_id long, __h int, m map<string,int>, `a.b` string").withColumns({"_n": F.lit(1), "_k": F.lit(2), "shard": F.lit("old")})
    got = sharding.assign(docs.repartition(3), shards=4)
    assert got.columns == ["doc_id", "__h", "m", "a.b", "_n", "_k", "row_no", "shard", "slot"]
    got = sorted(got.collect(), key=lambda r: r.row_no)
    assert [r.row_no for r in got] == list(range(len(rows))) and len({(r.shard, r.slot) for r in got}) == len(rows)
    assert sorted(((r.doc_id, r["__h"], r.m, r["a.b"]) for r in got), key=repr) == sorted(rows, key=repr)
    assert [r.doc_id for r in got] == [None, None, 3] + [5] * 43
    assert sum(x["__h"] != y["__h"] for x, y in zip(got[3:], got[4:])) == 1  # equal rows stand together
    again = {r.row_no: (r.doc_id, r["__h"], r.m) for r in sharding.assign(docs.coalesce(1), shards=4).collect()}
    assert again == {r.row_no: (r.doc_id, r["__h"], r.m) for r in got}


def test_permutation_is_one():
    for n in (1, 2, 3, 7, 64, 1000):
        p = sharding.permute(np.arange(n), n)
        assert sorted(p.tolist()) == list(range(n)) and np.array_equal(sharding.permute(p, n, back=True), np.arange(n))


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_decontamination(spark, broadcast):
    item = "one two three four five six seven eight nine ten eleven twelve"
    w = item.split()
    turned = " ".join(w[6:] + ["zzz"] + w[:6])
    rows = [(1, f"x y {item} z"), (2, turned), (3, "nothing here at all"), (4, None), (None, item), (1, f"{item}"), (5, " ".join(w[:4]))]
    found = decontamination.find(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, item), (8, None), (7, "")], "item_id long, text string"), broadcast_bytes=broadcast)
    assert {(r.doc_id, r.item_id, r.tiles, r.coverage) for r in found.collect()} == {(1, 9, 1, 1.0), (2, 9, 2, 1.0)}


def _tiles(a, b, least):
    """Greedy string tiling by comparing every pair of places."""
    used_a, used_b, tiles = set(), set(), []
    while True:
        best, top = [], least
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > top:
                    best, top = [(i, j)], n
                elif n == top:
                    best.append((i, j))
        if not best:
            return tiles
        for i, j in best:
            if used_a.isdisjoint(range(i, i + top)) and used_b.isdisjoint(range(j, j + top)):
                used_a.update(range(i, i + top))
                used_b.update(range(j, j + top))
                tiles.append((i, j, top))


def test_tiling_against_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(150):
        a, b = (rng.integers(1, rng.integers(2, 6), n).astype(np.uint64) for n in rng.integers(1, 30, 2))
        assert decontamination.tile(a, b, 3) == _tiles(a.tolist(), b.tolist(), 3)


@pytest.mark.parametrize("broadcast", [0, 1 << 20])
def test_decontamination_against_brute_force(spark, broadcast):
    rng = random.Random(14)
    items = [(k, _text(rng, n, 300)) for k, n in enumerate((30, 12, 5, 4, 1, 2, 40))] + [(None, "a b"), (50, "İstanbul ÀÉ straße ÿ ω"), (51, _text(rng, 8, 4)), (4, "repeated item id here now")]
    docs = [(100, None), (101, ""), (102, "--"), (103, items[0][1]), (103, items[0][1]), (None, items[1][1]), (104, "x İSTANBUL àé STRASSE ÿ Ω"), (105, "i̇stanbul àé straße Ÿ Ω end"), (106, "w1 " * 5000 + items[6][1]), (107, "Repeated ITEM id here now"), (108, "w1 w1 w1 w1 w2")]
    for k in range(60):
        parts = [_text(rng, rng.randrange(1, 12), 300) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            w = items[rng.choice([0, 1, 2, 6])][1].split()
            i = rng.randrange(len(w))
            parts.insert(rng.randrange(3), " ".join(w[i:] + w[:i])[: rng.randrange(10, 400)])
        docs.append((k, " ".join(parts)))
    want = {}
    for d, text in docs:
        for i, item in items:
            a, b = _folded(text), _folded(item)
            if d is None or i is None or not a or not b or len(a) > 1000:
                continue
            tiles = _tiles(a, b, min(decontamination.SEED_WORDS, len(b)))
            matched = sum(t[2] for t in tiles)
            if matched >= decontamination.COVERAGE * len(b) and tiles:
                best = (matched / len(b), matched, len(tiles))
                want[d, i] = max(best, want.get((d, i), best))
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"h": F.lit(1), "n": F.lit("x"), "a.b": F.lit(2), "item_id": F.lit(3)})
    found = decontamination.find(rows, spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=broadcast).collect()
    got = {(r.doc_id, r.item_id): (r.coverage, r.matched, r.tiles) for r in found}
    assert got.pop((106, 6))[0] == 1.0
    assert {k: v for k, v in got.items() if k[0] != 106} == want and len(want) > 30 and len(found) == len(got) + 1


def test_tiling_of_repeated_words():
    a, b = np.ones(4000, np.uint64), np.ones(3000, np.uint64)
    began = time.process_time()
    assert decontamination.tile(a, b, 5) == [(0, 0, 3000)]
    mixed = np.tile(np.array([1, 1, 1, 1, 1, 1, 2], np.uint64), 600)
    assert sum(t[2] for t in decontamination.tile(mixed, np.ones(3000, np.uint64), 5)) == 3000
    assert time.process_time() - began < 5


def test_decontamination_empty(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e")], "item_id long, text string")
    for broadcast in (0, 1 << 20):
        assert decontamination.find(docs.limit(0), items, broadcast_bytes=broadcast).count() == 0
        assert decontamination.find(docs, items.limit(0), broadcast_bytes=broadcast).count() == 0
        assert decontamination.find(docs, items, broadcast_bytes=broadcast).count() == 1


def test_decontamination_stage_columns(spark, tmp_path):
    item = "one two three four five six"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, item, 1, 2), (2, "other words", 3, 4)], "doc_id long, text string, `a.b` int, _row int")
    left = decontamination.drop_contaminated(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "other words", 3, 4)]
    kept = jaccard.keep_one(spark, docs.union(docs), "")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(1, item, 1, 2), (2, "other words", 3, 4)]


def test_bpe_matches_tiktoken_and_decodes(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    tokens = bpe.read_ranks()
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    texts = ["", "hello  world", "naïve café — 你好 <|endoftext|>", "a" * 3000, "  \n\n x  ", *(r.text for r in docs.limit(20).collect() if r.text)]
    encoder = bpe.Encoder(tokens)
    for t in texts:
        assert encoder.encode(t).tolist() == other.encode_ordinary(t)
        assert encoder.decode(encoder.encode(t)).tobytes().decode() == t
    out = bpe.encode(docs, encoder)
    assert out.columns == ["doc_id", "n_chars", "lang", "tokens", "n_tokens", "exact"]
    assert out.where("NOT exact").count() == 0 and out.where("tokens IS NULL").count() == 1


def test_bpe_rows(spark):
    encoder = bpe.Encoder(bpe.read_ranks())
    rows = [(1, "ab", "k"), (1, "ab", "k"), (2, None, None), (3, "", "x"), (None, "é" * 20_000 + " z", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tokens string").withColumn("a.b", F.lit(1))
    out = bpe.encode(docs, encoder)
    assert out.columns == ["doc_id", "a.b", "tokens", "n_tokens", "exact"]
    assert sorted(((r.doc_id, r.n_tokens, r.exact) for r in out.collect()), key=repr) == sorted([(1, 1, True), (1, 1, True), (2, None, None), (3, 0, True), (None, len(encoder.encode(rows[4][1])), True)], key=repr)
    back = bpe.decode(out.withColumn("text", F.lit("old")), encoder)
    assert back.columns == ["doc_id", "a.b", "tokens", "n_tokens", "exact", "text"]
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted([(d, t) for d, t, _ in rows], key=repr)
    odd = spark.createDataFrame([(1, [0, 60_000_000]), (2, [-1]), (3, [None]), (4, []), (5, None), (6, [encoder.lookup[b"\xff"]])], "id int, tokens array<int>")
    assert {r.id: r.text for r in bpe.decode(odd, encoder).collect()} == {1: None, 2: None, 3: None, 4: "", 5: None, 6: "\ufffd"}
    assert bpe.encode(docs.limit(0), encoder).count() == 0 and bpe.decode(odd.limit(0), encoder).count() == 0


def test_html():
    body = "This is a long paragraph, with commas, and words that go on for a while so that it counts. " * 3
    title, text, score, n = html.extract(f"<title>T</title><div class=nav><a href=x>one, two, three, four, five, six, seven</a></div><div class=article><p>{body}</p><p>{body}</p></div>")
    assert title == "T" and "long paragraph" in text and "seven" not in text and n >= 2
    assert html.extract("")[1] == ""


@pytest.mark.parametrize(
    "page",
    ["<a " + '""' * 20, "<a " + '""' * 250_000, "<a " * 300_000, "<table><tr><td>some text, here and there " * 20_000, "<b>" * 50_000 + "</i>" * 200_000, "<b>" * 50_000 + "<li></li>" * 100_000, "<b>" * 50_000 + "<ul>" * 100_000]
    + ["<title>" * 140_000, "<!" * 500_000, "<pre>word, word, word, word, word" * 30_000, "<a \"'\"<a '\"'" * 80_000, "<p class" + " " * 500_000 + ">", "<" * 1_000_000, "&" * 1_000_000],
)
def test_html_takes_linear_time(page):
    began = time.process_time()
    html.extract(page)
    assert time.process_time() - began < 4  # about 1 s a MB where nothing else runs


def test_html_tags_and_ends():
    body = "Here is a sentence of some length, with a comma in it."
    assert html.extract(f'<div><p title="x < y">{body}</p></div>')[1] == body
    assert html.extract(f'<div class="a>{body}</div>')[1] == body
    assert html.extract("<ul><li>one <b>two<li>three</ul>")[1].split("\n") == ["one two", "three"]
    assert html.extract("<table><tr><td>a<td>b<tr><td>c</table>")[1].split("\n") == ["a", "b", "c"]
    assert html.extract("a <b> </i> c </b> < d")[1] == "a c < d"


def _scores(page):
    """Container scores by the rule of the docstring, from the tree alone, text by text."""
    root, _ = html.parse(page)
    nodes = html._order(root)

    def strings(node, links=False):
        for p in node.parts:
            if isinstance(p, str):
                if not links and p.strip():
                    yield re.sub(r"\s+", " ", p)
            elif links and p.tag == "a":
                yield from strings(p)
            else:
                yield from strings(p, links)

    def has_block(node):
        return any(not isinstance(p, str) and (p.tag in html._BLOCK or has_block(p)) for p in node.parts)

    def density(node):
        return sum(map(len, strings(node, True))) / max(1, sum(map(len, strings(node))))

    score = {}
    for node in nodes:
        n, commas = sum(map(len, strings(node))), sum(s.count(",") for s in strings(node))
        if node.up is None or n < html.PARAGRAPH or not (node.tag in ("p", "pre", "td") or node.tag == "div" and not has_block(node)):
            continue
        up = node.up
        for share in (1, 2, 3):
            if up is not None:
                start = html._START.get(up.tag, 0) + 25 * bool(html._GOOD.search(up.names)) - 25 * bool(html._BAD.search(up.names))
                score[id(up)] = score.get(id(up), start) + (1 + commas + min(n // 100, 3)) * (1 - density(node)) / share
                up = up.up
    return max([score[id(n)] * (1 - density(n)) for n in nodes if id(n) in score], default=0.0)


def test_html_scores_against_brute_force(spark):
    rng = random.Random(8)
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    for _ in range(60):
        parts = [rng.choice(["<div>", "</div>", "<div class=story>", "<p>", "</p>", "<td>", "<ul>", "<li>", "<a href=x>", "</a>", "<span>", "some words, and a few more of them ", "x, y ", "&amp; "]) for _ in range(60)]
        pages.append("".join(parts))
    for page in pages:
        if page and "<form" not in page and "&" not in page:
            assert html.extract(page)[2] == pytest.approx(_scores(page))


def test_html_pages(spark):
    rows = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (3, "<p>" + "long text, " * 200_000, "c"), (None, "<div><p>Some words, that make a paragraph of a page.</p></div>", "d")]
    out = html.extract_pages(spark.createDataFrame(rows, "page_id long, html string, `text` string").selectExpr("*", "1 AS score", "2 AS `a.b`"))
    assert out.columns == ["page_id", "a.b", "title", "text", "score", "paragraphs"]
    got = [(r.page_id, r.title, r.text and len(r.text), r.paragraphs) for r in out.collect()]
    assert sorted(got, key=repr) == sorted([(1, None, None, 0), (2, "", "", 0), (2, "", "", 0), (3, "", 2_199_999, 1), (None, "", 44, 1)], key=repr)
    assert html.extract_pages(spark.createDataFrame([], "page_id long, html string")).count() == 0


def _grid(seed, h, w, c):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c)).astype(np.uint8)


def test_media_kinds():
    colour, grey_, bits = _grid(6, 9, 13, 3), _grid(7, 9, 13, 1), _grid(8, 9, 13, 1) // 128 * 255
    for image, data in [
        *[(colour, media.encode_netpbm(colour, k)) for k in (3, 6, 7)], *[(grey_, media.encode_netpbm(grey_, k)) for k in (2, 5, 7)], *[(bits, media.encode_netpbm(bits, k)) for k in (1, 4)],
        (colour, media.encode_netpbm(colour, 6, 65535)), (grey_, media.encode_netpbm(grey_, 2, 65535)), (colour, media.encode_bmp(colour)), (colour, media.encode_bmp(colour, 32)),
        (np.repeat(grey_, 3, 2), media.encode_bmp(grey_, 8)), (np.repeat(bits, 3, 2), media.encode_bmp(bits, 1)), (np.repeat(grey_ // 17 * 17, 3, 2), media.encode_bmp(grey_ // 17 * 17, 4)),
    ]:
        assert np.array_equal(media.decode(data), image)
        assert np.array_equal(media.decode(data[:2] + data[2:].replace(b"# tile", b"#")), image)


def test_media_packed_and_old_bmp():
    palette = b"".join(bytes([k, 0, 255 - k, 0]) for k in range(256))
    head = lambda bits, packing, size: b"BM" + struct.pack("<IHHI", 0, 0, 0, 54 + 4 * (1 << bits)) + struct.pack("<IiiHHIIiiII", 40, 5, 2, 1, bits, packing, size, 0, 0, 0, 0) + palette[: 4 << bits]
    eight = head(8, 1, 0) + bytes([3, 9, 0, 3, 1, 2, 3, 0, 0, 0, 0, 2, 1, 0, 2, 7, 0, 1])
    assert media.decode(eight)[:, :, 2].tolist() == [[0, 7, 7, 0, 0], [9, 9, 9, 1, 2]]
    four = head(4, 2, 0) + bytes([4, 0x12, 0, 0, 0, 3, 0x34, 0x50, 0, 1])
    assert media.decode(four)[:, :, 2].tolist() == [[3, 4, 5, 0, 0], [1, 2, 1, 2, 0]]
    old = b"BM" + struct.pack("<IHHI", 0, 0, 0, 32) + struct.pack("<IHHHH", 12, 3, 1, 1, 1) + bytes([1, 2, 3, 4, 5, 6]) + bytes([0b01000000, 0, 0, 0])
    assert media.decode(old).tolist() == [[[3, 2, 1], [6, 5, 4], [3, 2, 1]]]
    short = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, 16, 0, 0, 0, 0, 0, 0) + struct.pack("<HH", 0x7C00, 0x1F)
    assert media.decode(short).tolist() == [[[255, 0, 0], [0, 0, 255]]]


def _area(image, height, width):
    """Area means pixel by pixel."""
    h, w, c = image.shape
    out = np.zeros((height, width, c))
    for y in range(height):
        for x in range(width):
            for i in range(h):
                for j in range(w):
                    share = max(0, min((y + 1) * h / height, i + 1) - max(y * h / height, i)) * max(0, min((x + 1) * w / width, j + 1) - max(x * w / width, j))
                    out[y, x] += image[i, j] * share
    return out / (h / height * w / width)


@pytest.mark.parametrize("block", [1 << 18, 40, 7, 1])
@pytest.mark.parametrize("h, w, c", [(9, 13, 3), (1, 1, 1), (3, 40, 1), (16, 16, 3), (37, 2, 3)])
def test_media_resize_and_hash(monkeypatch, block, h, w, c):
    monkeypatch.setattr(media, "BLOCK", block)
    image = _grid(h * w, h, w, c)
    want = _area(image, 5, 4)
    assert np.allclose(media.resize(image, 5, 4), want)
    tile, bits = media.tile_of(media.opened(media.encode_netpbm(image, 6 if c == 3 else 5)), 5)
    assert np.abs(tile - _area(image, 5, 5)).max() < 0.500001
    small = np.rint(_area(media.grey(image), 8, 9)[:, :, 0] * 256)
    want_bits = sum(1 << (63 - 8 * y - x) for y in range(8) for x in range(8) if small[y, x] > small[y, x + 1])
    assert bits == want_bits - (1 << 64 if want_bits >> 63 else 0) == media.dhash(image)


def test_media_rows(spark, tmp_path):
    good = _grid(1, 4, 6, 3)
    bad = [b"", b"x", b"P6", b"P5\n9 9\n255\n", b"P2 2 1 255 " + b"9" * 30 + b" 1", b"P2 2 1 255 1 x", b"P2 2 1 255 256 1", b"P5 " + b"9" * 40 + b" 1 255 ", b"P4 99999999 99999999 1", b"P7\nWIDTH x\nENDHDR\n", b"BM" + b"\0" * 60, media.encode_bmp(good)[:-5]]
    bad.append(b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1 << 30, 1 << 30, 1, 8, 1, 0, 0, 0, 0, 0) + b"\0" * 2000)
    large = b"P4 32768 8192\n" + b"\0" * (1 << 25)
    rows = [(k, x, "t", k) for k, x in enumerate([None, media.encode_bmp(good), media.encode_bmp(good), large, *bad])]
    out = media.tiles(spark.createDataFrame(rows, "id long, media binary, tile string, `a.b` int"), size=3)
    assert out.columns == ["id", "a.b", "width", "height", "channels", "tile", "dhash", "error"]
    got = {r.id: r for r in out.collect()}
    assert got[0].error is None and got[0].tile is None and got[1].tile == got[2].tile and got[3].width == 32768
    assert all(got[k].error and got[k].width is None and got[k].tile is None for k in range(4, len(rows)))
    assert np.abs(np.load(io.BytesIO(got[1].tile)) - _area(good, 3, 3)).max() < 0.500001
    assert media.write_npy(out, str(tmp_path), "id") == 3
    assert (tmp_path / "1.npy").read_bytes() == bytes(got[1].tile)
    assert media.tiles(out.select("id", "tile").limit(0), "tile").count() == 0


def test_media_pictures(spark):
    rows = spark.createDataFrame([(k, [0.1 * k, 1.0, -1.0, None]) for k in range(26)] + [(None, [1.0]), (50, []), (51, None)], "vec_id long, embedding array<double>")
    out = media.tiles(media.pictures(rows))
    assert out.where("error IS NOT NULL").count() == 0 and out.where("tile IS NULL").count() == 2


def _labelled(spark, sf="/root/testdata/sf0.1"):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", "toxic").orderBy("doc_id").collect()
    return rows


@pytest.mark.parametrize("module, label, least", [(quality, "quality", 0.9), (toxicity, "toxic", 0.9)])
def test_held_out_accuracy(spark, module, label, least):
    rows = [r for r in _labelled(spark) if r.text]
    train, test = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    model = module.train([r.text for r in train], [r[label] for r in train])
    p = module.probabilities(model, pa.array([r.text for r in test])) >= module.THRESHOLD
    y = np.array([r[label] for r in test]) == 1
    assert (p[y].mean() + (~p[~y]).mean()) / 2 >= least


def test_pipeline_stages(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_passages", "decontamination", "encoding"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.where("NOT exact").count() == 0 and 0 < out.count() < 200


def _folded(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", pc.utf8_lower(pa.scalar(text or "")).as_py())  # letter by letter


def _scored_by_hand(rows, vocab, model):
    """(n_tokens, mean log-probability) of each row, word by word, and a function that gives a word's probability."""
    counts, classes = {}, {}
    for _, t in rows:
        for w in _folded(t):
            counts[w] = counts.get(w, 0) + 1
    own = language_model.words(pa.array(list(counts)), True)
    to, rare = vocab.of(own.hash, own.end - own.start)
    outcome, is_rare = dict(zip(counts, to.tolist())), dict(zip(counts, rare.tolist()))
    for w, n in counts.items():
        if is_rare[w]:
            classes[outcome[w]] = classes.get(outcome[w], 0) + n
    group = {i: g for g, (lo, hi) in enumerate(zip(vocab.starts[:-1], vocab.starts[1:])) for i in range(lo, hi)}

    def probability(second, last, word):
        q = model.context[second] * model.place[0] + model.context[last] * model.place[1]
        score = lambda rows: np.exp((rows[:, :-1] @ q + rows[:, -1]).astype(float))
        i = outcome[word]
        every, g = score(model.group), group[i]
        inside = score(model.target[vocab.starts[g] : vocab.starts[g + 1]])
        p = every[g] / every.sum() * inside[i - vocab.starts[g]] / inside.sum()
        return p * (counts[word] / classes[i] if is_rare[word] else 1)

    out = []
    for _, t in rows:
        w = _folded(t)
        ids = [vocab.mark, vocab.mark, *(outcome[x] for x in w)]
        out.append((len(w), np.mean([np.log(probability(ids[k], ids[k + 1], x)) for k, x in enumerate(w)]) if w else None))
    return out, probability, list(counts), is_rare


def test_language_model_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_model, "WORDS", 150)
    rng = random.Random(5)
    rows = [(k, _text(rng, 120, 600)) for k in range(30)] + [(100, "a b b " + "once" * 9), (101, None), (102, ""), (103, "!?"), (None, "w1 w2"), (100, "w1 w1 zzz"), (100, "w1 w1 zzz")]
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, uid int, own int, `a.b` int")
    vocab = language_model.vocabulary(docs)
    assert len(vocab.hashes) == 150 and vocab.total == sum(len(_folded(t)) for _, t in rows)
    model = language_model.train(docs, vocab)
    want, probability, every, is_rare = _scored_by_hand(rows, vocab, model)
    assert sum(is_rare.values()) > 300
    got = sorted([(r.doc_id, r.n_tokens, r.mean_log_prob, r.perplexity) for r in language_model.score(docs, vocab, model).collect()], key=lambda r: (repr(r[0]), r[1], r[2] or 0))
    want = sorted([(k, n, p) for (k, _), (n, p) in zip(rows, want)], key=lambda r: (repr(r[0]), r[1], r[2] or 0))
    for (k, n, p, e), (i, m, q) in zip(got, want, strict=True):
        assert (k, n) == (i, m) and (p is None) == (q is None) == (e is None)
        assert p is None or (p == pytest.approx(q, abs=1e-4) and e == pytest.approx(np.exp(-p)))
    for second, last in ((vocab.mark, vocab.mark), (3, 90)):
        seen = {int(x) for x in vocab.other[vocab.tokens > 0]}
        rest = [i for i in vocab.other.tolist() if i not in seen]  # classes that no word has
        p = sum(probability(second, last, w) for w in every)
        assert 0.9 < p < 1.0001 and (rest or p > 0.9999)


def test_language_model_ignores_partitions(spark, docs, monkeypatch):
    monkeypatch.setattr(language_model, "SHARD", 5000)

    def scores(own):
        vocab = language_model.vocabulary(own)
        return sorted([(repr(r.doc_id), r.n_tokens, r.mean_log_prob or 0.0) for r in language_model.score(own, vocab, language_model.train(own, vocab)).collect()])

    one, other = scores(docs.coalesce(1)), scores(docs.repartition(7, "n_chars"))
    assert [x[:2] for x in one] == [x[:2] for x in other]
    assert np.allclose([x[2] for x in one], [x[2] for x in other], atol=1e-5)


def test_language_model_empty(spark):
    empty = spark.createDataFrame([(1, None), (2, ""), (3, "--")], "doc_id long, text string")
    assert language_model.vocabulary(empty) is None
    assert sorted(tuple(r) for r in language_model.score(empty, None, None).collect()) == [(k, 0, None, None) for k in (1, 2, 3)]
    assert language_model.score(empty.limit(0), None, None).count() == 0


def _hash_gram(gram):
    h = 0
    for c in gram:
        h = (h * 0x01000193 + c + 1) & 0xFFFFFFFF
    x = ((h ^ (h >> 15)) * 0x2C1B3C6D + len(gram)) & 0xFFFFFFFF
    x ^= x >> 12
    return ((x * 0x297A2D39) & 0xFFFFFFFF) >> (32 - toxicity.BITS)


def test_toxicity_forward():
    """Bags and probabilities against loops over words and bytes."""
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(0, 3, toxicity.BUCKETS).astype(np.float32), -0.3)
    texts = ["Some words, some WORDS again", "naïve  é", "a", "", "--", None, "x" * 5000, "zu kurz ab"]
    want = []
    for t in texts:
        bag = []
        for w in _folded(t):
            body = b"\0" + w.encode() + b"\0"
            bag += [_hash_gram(body[i : i + n]) for n in toxicity.SIZES for i in range(len(body) - n + 1)]
        mean = sum(float(model.logit[g]) for g in bag) / (len(bag) + toxicity.BLANKS)
        want.append(1 / (1 + np.exp(-(mean + model.bias))) if bag else 0.0)
    assert toxicity.probabilities(model, pa.array(texts)) == pytest.approx(want, abs=1e-6)


def test_toxicity_gradients():
    rng = np.random.default_rng(4)
    emb, soft, bias = rng.normal(0, 1, (30, 6)), rng.normal(0, 1, (6, 2)), rng.normal(0, 1, 2)
    size = np.array([5, 3, 7])
    ids, part = np.concatenate([rng.permutation(30)[:n] for n in size]), rng.random(15)
    begin, target, weight = np.cumsum(size) - size, np.eye(2)[[1, 0, 1]], np.array([1.0, 2.0, 0.5])

    def loss():
        total = 0.0
        for k in range(3):
            own = slice(begin[k], begin[k] + size[k])
            z = (emb[ids[own]] * part[own, None]).sum(0) @ soft + bias
            total += weight[k] / 3 * (np.log(np.exp(z).sum()) - z @ target[k])
        return total

    back, gs, gb = toxicity.gradients(emb, soft, bias, ids, part, begin, target, weight)
    ge = np.zeros_like(emb)
    np.add.at(ge, ids, np.repeat(back, size, axis=0) * part[:, None])
    for values, grads in ((emb, ge), (soft, gs), (bias, gb)):
        for at in np.ndindex(values.shape):
            keep = values[at]
            values[at] = keep + 1e-5
            up = loss()
            values[at] = keep - 1e-5
            down = loss()
            values[at] = keep
            assert grads[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_toxicity_misspelling():
    rng = random.Random(6)
    bad = ["scoundrel", "blackguard", "nincompoop"]
    texts = [_text(rng, 12) + (f" you {rng.choice(bad)} and {rng.choice(bad)} " if k % 2 else " ") + _text(rng, 12) for k in range(300)]
    model = toxicity.train(texts, [k % 2 for k in range(300)])
    unseen = ["you scounndrel and blakguard", "you nincompooop and scoundrell"]
    p = toxicity.probabilities(model, pa.array([_text(rng, 12) + " " + x + " " + _text(rng, 12) for x in [*unseen, "we walk and talk", "you and me and them"]]))
    assert p[:2].min() > 0.5 > p[2:].max()


@pytest.mark.parametrize("module, column", [(toxicity, "toxic_prob"), (quality, "quality_prob")])
def test_classifier_rows(spark, module, column):
    label = "toxic" if module is toxicity else "quality"
    rows = [(1, None), (2, ""), (3, "good words here"), (3, "good words here"), (None, "good words here"), (4, "x " * 100_000)]
    docs = spark.createDataFrame([(k, t, 1.0, 2) for k, t in rows], f"doc_id long, text string, {column} double, `a.b` int")
    for labels, rest in (([], 0.0 if module is toxicity else 1.0), ([(3, 1), (99, 0)], 1.0), ([(3, 0)], 0.0), ([(3, None)], 0.0 if module is toxicity else 1.0)):
        model = module.fit(docs, spark.createDataFrame(labels, f"doc_id long, {label} int"))
        got = sorted(((r.doc_id, getattr(r, column)) for r in module.score(docs, model).collect()), key=repr)
        assert got == sorted([(1, 0.0), (2, 0.0), (3, rest), (3, rest), (None, rest), (4, rest)], key=repr)
    assert module.score(docs.limit(0), module.fit(docs.limit(0), spark.createDataFrame([], f"doc_id long, {label} int"))).count() == 0


def test_quality_forward():
    """Probabilities against loops over chunks, places and filters."""
    rng = np.random.default_rng(5)
    net = quality.Net(rng.normal(0, 1, (quality.WIDTH, 256, quality.FILTERS)).astype(np.float32), *(rng.normal(0, 1, s).astype(np.float32) for s in ((quality.FILTERS, quality.HIDDEN), quality.HIDDEN, quality.HIDDEN)), 0.1)
    texts = ["short", "é" * 40, "some text of a few words. " * 9, "x" * 64, "y" * 57, "", None, "z" * 700]

    def one(text):
        body = (text or "").encode()
        n, w, b = len(body), quality.WIDTH, quality.BLOCK
        if not n:
            return 0.0
        blocks = -(-(n + w - 1) // b)
        at = [[sum(net.taps[k][(body + b"\0" * w)[i + k]] for k in range(w)) for i in range(lo * b, min(n, lo * b + b))] for lo in range(blocks)]
        hidden = []
        for k in range(max(1, blocks - 1)):
            places = at[k] + (at[k + 1] if blocks > 1 else [])
            pooled = np.maximum(np.max(places, axis=0), 0)
            hidden.append(np.maximum(pooled @ net.w1 + net.b1, 0))
        return 1 / (1 + np.exp(-np.clip(np.max(hidden, axis=0) @ net.w2 + net.b2, -30, 30)))

    assert quality.probabilities(net, pa.array(texts)) == pytest.approx([one(t) for t in texts], abs=1e-4)


def test_quality_stage_keeps_rows(spark, tmp_path):
    spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, "a", 1, "x"), (None, "b", 2, "y"), (3, None, 3, "z"), (4, "", 4, None), (1, "a", 1, "x")], "doc_id long, text string, `a.b` int, keep string")
    kept = quality.keep_good(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, "a", 1, "x"), (1, "a", 1, "x"), (None, "b", 2, "y")], key=repr)


def test_nce_gradients():
    """Gradients against differences of the objective, worked out in double precision."""
    n = 40
    share = np.full(n, 1 / n, np.float32)
    vocab = language_model.Vocabulary(np.arange(n - language_model.CLASSES if n > language_model.CLASSES else 0).astype(np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64), share, language_model._starts(n), n)
    trainer = language_model.Trainer(vocab, 1)
    rng = np.random.default_rng(2)
    trainer._hold(np.arange(n + 1 + language_model.GROUPS))
    second, last, to = (rng.integers(0, n, 12) for _ in range(3))
    noise = rng.integers(0, n, language_model.NOISE)
    outcomes = [(to, noise), (vocab.group(to) + n + 1, vocab.group(noise) + n + 1)]

    def objective():
        c, t, place = trainer.context.astype(float), trainer.target.astype(float), trainer.place.astype(float)
        q = np.concatenate([c[second] * place[0] + c[last] * place[1], np.ones((12, 1))], axis=1)
        total = 0.0
        for true, false in outcomes:
            x = (q * t[true]).sum(1) - trainer.noise_log[true] - np.log(language_model.NOISE)
            y = q @ t[false].T - trainer.noise_log[false] - np.log(language_model.NOISE)
            total += -np.log1p(np.exp(-x)).sum() - np.log1p(np.exp(y)).sum()
        return total

    place, parts = trainer.gradients(second, last, outcomes)
    full = [np.zeros_like(trainer.context), np.zeros_like(trainer.target)]
    for f, (ids, g) in zip(full, parts):
        np.add.at(f, ids, g)
    for values, grads in ((trainer.context, full[0]), (trainer.target, full[1]), (trainer.place, place)):
        for _ in range(25):
            at = tuple(rng.integers(0, k) for k in values.shape)
            keep, step = values[at], 2.0**-7
            values[at] = keep + step
            up = objective()
            values[at] = keep - step
            down = objective()
            values[at] = keep
            assert grads[at] == pytest.approx((up - down) / (2 * step), abs=2e-2, rel=2e-2)


def test_html_forms_and_svg():
    body = "This is a sentence of the article, with commas, that goes on for quite some time and says nothing. " * 2
    page = f"<body><form id=aspnetForm><input type=hidden><div><p>{body}</p><p>{body}</p></div></form></body>"
    assert html.extract(page)[1].count("sentence") == 4
    assert html.extract("<form>" + "words of a page, without any paragraph <br>" * 10 + "</form>")[1].count("words of a page") == 10
    login = "<form><p>Please type in your name, or your number.</p></form>"
    links = "<form>" + "<p><a href=x>one of many links, all in a form</a></p>" * 20 + "</form>"
    text = html.extract(f"<div>{login}<p>{body}</p>{links}</div>")[1]
    assert "sentence" in text and "Please" not in text and "links" not in text
    for svg in ("<svg class=i viewBox='0 0 1 1'/>", "<svg><path d=x /></svg>"):
        assert html.extract(f"<div>{svg}<p>{body}</p></div>")[1].count("sentence") == 2


def test_stages_judge_rows(spark, tmp_path):
    rng = random.Random(9)
    a, b, c, d, item = (_text(rng, 60, 5000) for _ in range(5))
    near = a.rsplit(" ", 1)[0] + " edited"
    rows = [(None, a), (4, near), (2, a), (None, b), (None, b), (7, c), (7, c), (7, d), (8, d), (None, None), (9, ""), (None, item), (10, item + " more"), (10, c + " " + b)]
    docs = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one(spark, docs, "").collect()]
    gone = [(None, a), (4, near), (None, b), (7, c), (8, d), (None, item)]
    want = list(rows)
    for r in gone:
        want.remove(r)
    assert sorted(kept, key=repr) == sorted(want, key=repr)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = [(r.doc_id, r.text) for r in decontamination.drop_contaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=repr) == sorted([r for r in rows if item not in (r[1] or "")], key=repr)

"""Queries against brute force, and rows of every odd kind."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from gapweave.llm import ann, bpe, chat_format, common, decontaminate, license_scan, quality, queries, sharding, simhash_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rep long, component string, node long, key string, carry string, h long, s string"
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 7, "x", 3, "k", "c", 9, "s") for i, t in rows], SCHEMA)


def _table(sf, name):
    return duckdb.sql(f"SELECT * FROM '{sf}/{name}.parquet'").df()


@pytest.fixture(scope="module")
def sf01():
    return "/root/testdata/sf0.01"


# -- 1 ------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [500, 2000])
def test_ann_recall_grows_no_share(n):
    """Recall at 20 of the shipped setting, and the share of the table that a query scores."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    f = ann.Forest(x[: ann.SAMPLE], 1.0, n, 20)
    leaf = f.leaves(x)
    hits = share = 0.0
    for q in range(0, n, 20):
        met = np.zeros(n, bool)
        for t, at in f.search(x[q], ann.probes_for(n, f.depth)):
            met |= leaf[t] == at
        s = x @ x[q]
        s[q] = -9
        hits += met[np.argsort(-s)[:20]].mean() / (n // 20)
        share += met.mean() / (n // 20)
    assert hits >= 0.9 and share < (0.9 if n == 500 else 0.75)


def test_ann_query_against_brute_force(spark, sf01):
    t = _table(sf01, "embeddings")
    x = {i: np.array(e, np.float64) for i, e in zip(t.vec_id, t.embedding)}
    got = defaultdict(list)
    for r in ann.op1_ann(spark, sf01).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r)
        assert abs(r.score - float(x[r.query_id] @ x[r.vec_id])) < 1e-12
    assert set(got) == {i for i in x if i % 20 == 0}
    hits = 0
    for q, rows in got.items():
        best = sorted((i for i in x if i != q), key=lambda i: (-float(x[q] @ x[i]), i))[:20]
        assert [r.rank for r in rows] == list(range(1, 21)) and [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += len(set(best) & {r.vec_id for r in rows})
    assert hits >= 0.9 * 20 * len(got)


def test_ann_crowded_cells_and_poor_leaves(spark, monkeypatch):
    """Cells in blocks, queries with too few leaves, and near-equal vectors in one leaf give the same best."""
    monkeypatch.setattr(ann, "BLOCK", 40)
    monkeypatch.setattr(ann, "CELL", 64)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 8))
    x[100:300] = x[0] + 1e-3 * rng.normal(size=(200, 8))
    x[350:] *= 3
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, cell int")
    got = defaultdict(list)
    for r in ann.nearest(df, "vec_id % 20 = 0", probes=1).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert len(got) == 20 and all(len(v) == 20 for v in got.values())
    whole = defaultdict(list)
    for r in ann.nearest(df, "vec_id % 20 = 0", probes=10**6).orderBy("query_id", "rank").collect():
        whole[r.query_id].append(r.vec_id)
    for q in whole:
        assert whole[q] == sorted((i for i in range(400) if i != q), key=lambda i: (-float(np.einsum("i,i->", x[q], x[i])), i))[:20]


# -- 2 ------------------------------------------------------------------------------------------------
def test_chat_clashing_names_and_long_texts(spark):
    long = "### a: b</turn>\\ " * 60_000  # 1 MB
    rows = [(1, 0, None, "user", long, 1.0), (1, 1, 0, "assistant", long[::-1], 1.0)]
    names = "conv string, node string, leaf string, up string, over string, far string, segment string, head string, under string, at string, _n string, turns string, whole string"
    df = spark.createDataFrame([r + tuple("abcdefghijklm") for r in rows], f"conv_id long, msg_id long, parent_id long, role string, text string, score double, {names}")
    (r,) = chat_format.read_back(chat_format.format_trees(df)).collect()
    assert [(t.role, t.text, t.loss) for t in r.turns] == [("user", long, ""), ("assistant", long[::-1], long[::-1])]


# -- 3 ------------------------------------------------------------------------------------------------
def test_license_scan_against_sql_and_layout(spark, sf01):
    want = duckdb.connect()
    want.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf01}/documents.parquet'")
    rows = want.execute(queries.oracle_sql()["op3_license_scan"]).fetchall()
    got = license_scan.op3_license_scan(spark, sf01).select("doc_id", "license", "containment", "first_word", "n_windows")
    assert sorted(map(tuple, got.collect())) == sorted(rows) and len(rows) > 20
    # a long text, and the same rows in other company: windows depend on the text alone
    mit = license_scan.LICENSES["MIT"]
    text = "word " * 333 + mit + " tail" * 200_001
    alone = license_scan.scan(_docs(spark, [(1, text)]).coalesce(1)).collect()
    many = license_scan.scan(_docs(spark, [(0, "x " * i) for i in range(40)] + [(1, text), (2, ""), (3, None)]).coalesce(1)).collect()
    assert list(map(tuple, alone)) == [tuple(r) for r in many] and alone[0].containment == 1.0 and alone[0].first_word == 333


# -- 4 ------------------------------------------------------------------------------------------------
def _naive(text):
    """Indices of byte n-grams and repeated-word n-grams, one by one."""
    data, out = (text or "").encode("utf-8", "surrogatepass"), set()
    for n in quality.GRAMS:
        for i in range(len(data) - n + 1):
            out.add(((int.from_bytes(data[i : i + n], "big") + n) * 2654435761 & 0xFFFFFFFF) >> (32 - quality.BITS))
    out -= set(range(quality.DIMENSIONS - len(quality.RUNS), quality.DIMENSIONS))
    words, run, longest = data.split(), 1, 1
    for a, b in zip(words, words[1:]):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    return out | {quality.DIMENSIONS - len(quality.RUNS) + k for k, n in enumerate(quality.RUNS) if longest >= n}


def test_quality_ratios_against_brute_force(spark, sf):
    docs, labels = _table(sf, "documents"), dict(_table(sf, "labels")[["doc_id", "quality"]].itertuples(index=False))
    rows = [(d, t) for d, t in zip(docs.doc_id, docs.text) if d in labels and zlib.crc32(str(d).encode()) % 5]
    count = {0: Counter(), 1: Counter()}
    for d, t in rows:
        count[labels[d]].update(_naive(t))
    n = Counter(labels[d] for d, _ in rows)
    want = np.zeros(quality.DIMENSIONS)
    for i in set(count[0]) | set(count[1]):
        want[i] = math.log((count[1][i] + 1) / (n[1] + 2)) - math.log((count[0][i] + 1) / (n[0] + 2))
    got = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert np.allclose(got.ratio, want, atol=1e-12)


def test_dual_descent_against_a_dense_solver(monkeypatch):
    monkeypatch.setattr(quality, "DIMENSIONS", 30)
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(30, rng.integers(3, 12), replace=False)) for _ in range(80)]
    signs = np.where(rng.random(80) < 0.3, -1.0, 1.0)
    ratio, cost = rng.normal(size=30), 2.0
    x = np.zeros((80, 31))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 30] = 1
    most = cost * np.where(signs > 0, 80 / (2 * (signs > 0).sum()), 80 / (2 * (signs < 0).sum()))
    value = lambda w: 0.5 * w @ w + (most * np.maximum(0, 1 - signs * (x @ w))).sum()
    # projected gradient on the dense dual, to rest
    gram, alpha = (x * signs[:, None]) @ (x * signs[:, None]).T, np.zeros(80)
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(60_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, most)
    best = value((alpha * signs) @ x)
    w, bias = quality._descend(rows, signs, ratio, cost, slack=1e-4)
    assert abs(value(np.append(w, bias)) - best) < 1e-3 * best
    loose = value(np.append(*quality._descend(rows, signs, ratio, cost)))
    assert loose < 1.01 * best


@pytest.mark.parametrize("n_labels", [59, 200_000])
def test_quality_with_far_more_or_fewer_labels(spark, n_labels):
    """The sample follows the labelled documents, however many labels there are."""
    docs = [(i, ("good words here " if i % 2 else "bad bad bad bad junk ") * (1 + i % 5)) for i in range(1, 400 if n_labels == 59 else 60)]
    lab = spark.range(n_labels).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS quality")
    d = _docs(spark, docs)
    out = {r.doc_id: r for r in quality.score(d, quality.fit(d, lab, sample=50)).collect()}
    assert len(out) == len(docs) and all((r.score > 0.5) == (i % 2 == 1) for i, r in out.items())


def test_quality_one_class_no_overlap_and_repeats(spark):
    d = _docs(spark, [(1, "a"), (2, "b"), (2, "b"), (None, None), (3, "x" * 1_200_000)])
    for rows in ([(1, 1), (2, 1)], [(1, 0)], [(77, 1), (78, 0)], []):
        lab = spark.createDataFrame(rows, "doc_id long, quality int")
        out = quality.score(d, quality.fit(d, lab)).collect()
        assert len(out) == 5 and len({r.score for r in out}) == 1 and 0 <= out[0].score <= 1
    hot = _docs(spark, [(1, "same text")] * 300 + [(i, f"other {i} " * 3) for i in range(2, 60)])
    lab = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    assert quality.score(hot, quality.fit(hot, lab, sample=20)).count() == 358


# -- 5, 8 ---------------------------------------------------------------------------------------------
def test_simhash_query_against_brute_force(spark, sf):
    docs = _table(sf, "documents")
    prints = {d: simhash_dedup.fingerprint(t) for d, t in zip(docs.doc_id, docs.text)}
    up = {d: d for d in prints}
    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = up[a], up[b]
                up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()} if x != y else up
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_dedup.op5_simhash(spark, sf).collect()}
    assert got == {d: (f"{p:016x}", up[d]) for d, p in prints.items()}


def test_sharding_query_laws(spark, sf01):
    docs = _table(sf01, "documents")
    body = {d: (t or "").encode() for d, t in zip(docs.doc_id, docs.text)}
    got = sharding.op8_sharding(spark, sf01).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in got} == {(d, len(b) + 16, zlib.crc32(b)) for d, b in body.items()} and len(got) == len(body)
    by = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert set(by) == set(range(40)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


# -- 6 ------------------------------------------------------------------------------------------------
def test_mended_joins_are_exact():
    """Tree concatenation of long unsplit text, cut at every kind of place, against the library."""
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(bpe.default_path()), bpe.vocabulary(bpe.default_path())
    rng = random.Random(7)
    words = ["the", "ing", "tion", "a", "er", "en", "aaaa", "abab", "zq", "é", "漢字", "ñ", "inter", "national", "s", "th", "hthth"]
    for case in range(400):
        text = "".join(rng.choice(words) for _ in range(rng.randint(2, 60)))
        text = re.sub(r"[^\w]", "", text).lower()
        want = lib.encode(text, add_special_tokens=False).ids
        symbols = mine.symbols(text)
        cut = rng.randint(1, len(symbols) - 1) if len(symbols) > 1 else 0
        assert mine.merge(symbols) == want
        if cut:
            assert mine.mend(mine.merge(symbols[:cut]), mine.merge(symbols[cut:])) == want, (text, cut)
    for text in ("ab" * 5000, "a" * 70_001, "interna" * 9000, "".join(rng.choice("abcdefg") for _ in range(50_000))):
        assert mine.encode_symbols(mine.symbols(text)) == lib.encode(text, add_special_tokens=False).ids


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 20_000)
    vocab = bpe.vocabulary(bpe.default_path())
    vocab.words.clear()
    for i in range(500):
        vocab.encode(f"word{i} and{i}")
        assert vocab.words.size <= 20_000 + 2000
    vocab.words.clear()
    assert not vocab.words and vocab.words.size == 0


# -- 10 -----------------------------------------------------------------------------------------------
def _tiler(text, item, least):
    """Greedy string tiling by its definition: the longest common run that no tile touches, again and again."""
    used_t, used_i, tiles = [False] * len(text), [False] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and not used_i[i + n] and not used_t[t + n] and item[i + n] == text[t + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, t)
        n, i, t = best
        if n < least:
            return tiles
        used_i[i : i + n], used_t[t : t + n] = [True] * n, [True] * n
        tiles.append((t, i, n))


def test_decontamination_query_against_brute_force(spark, sf):
    docs, items = _table(sf, "documents"), _table(sf, "benchmark")
    words = lambda s: re.findall("[a-z0-9\x80-\U0010ffff]+", (s or "").lower())
    grams = lambda w: set(zip(*[w[k:] for k in range(5)]))
    want = {}
    for i, x in zip(items.item_id, items.text):
        item = words(x)
        own = grams(item)
        for d, t in zip(docs.doc_id, docs.text):
            text = words(t)
            shared = own & grams(text)
            if not shared:
                continue
            # the parts of the text that no shared run of five words covers can hold no tile
            cover = [any(tuple(text[k : k + 5]) in shared for k in range(max(0, p - 4), p + 1)) for p in range(len(text))]
            tiles = _tiler([w if c else None for w, c in zip(text, cover)], item, 5)
            if sum(n for _, _, n in tiles) >= 0.8 * len(item):
                want[d, i] = (sum(n for _, _, n in tiles), len(tiles), len(item))
    got = {(r.doc_id, r.item_id): (r.n_matched, r.n_tiles, r.n_words) for r in decontaminate.op10_decontaminate(spark, sf).collect()}
    assert got == want and want


def test_clean_with_many_blocks(spark, sf):
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    one = sorted(map(tuple, decontaminate.clean(docs, bench).collect()))
    assert one == sorted(map(tuple, decontaminate.clean(docs, bench, limit=300).collect())) and 0 < len(one) < docs.count()


# -- every stage and operator on odd rows -------------------------------------------------------------
LONG = "lorem ipsum dolor sit amet consetetur " * 40_000  # 1.5 MB
ODD = [(1, None), (2, ""), (3, " \n "), (4, "one two"), (None, "one two"), (None, None), (5, "word " * 400), (6, "word " * 400), (6, "word " * 400), (6, "other text of that id"), (7, "é漢字🙂 " * 40), (8, LONG), (9, LONG + "x")]


@pytest.mark.parametrize("stage", [quality.stage, simhash_dedup.stage, suffix_dedup.stage, decontaminate.stage, bpe.stage], ids=lambda f: f.__module__.split(".")[-1])
def test_stages_on_odd_rows(spark, sf, stage):
    assert stage.__doc__
    docs = _docs(spark, ODD)
    out = stage(spark, docs, sf)
    rows = out.collect()
    none = stage(spark, _docs(spark, []), sf)
    assert none.count() == 0
    if stage is bpe.stage:
        assert len(rows) == len(ODD) and all(r.n_tokens == len(r.ids) for r in rows)
        return
    assert out.columns == NAMES == none.columns
    got = Counter((r.doc_id, r.text) for r in rows)
    if stage is decontaminate.stage:
        assert got == Counter(ODD)
    if stage is quality.stage:
        assert set(got) <= set(ODD) and all(got[k] == Counter(ODD)[k] for k in got)  # rows with equal texts share a fate
    if stage is simhash_dedup.stage:
        assert got == Counter([(1, None), (4, "one two"), (5, "word " * 400), (6, "other text of that id"), (7, "é漢字🙂 " * 40), (8, LONG)])
    if stage is suffix_dedup.stage:
        assert len(rows) == len(ODD) and sum(len(r.text) for r in rows) < 20_000
        assert Counter(r.doc_id for r in rows) == Counter(d for d, _ in ODD) and all(r.n_chars == len(r.text) for r in rows)


def test_pipeline_stages_catch_what_they_are_for(spark, sf):
    """Near copies go, repeated passages and benchmark texts too, clean documents stay as they are."""
    rng = random.Random(9)
    fresh = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))
    base, passage = fresh(200), fresh(60)
    item = _table(sf, "benchmark").text[0]
    near = base.split()
    near[100] = "changed"
    rows = [(1, base), (2, " ".join(near)), (3, base), (4, f"{fresh(80)} {passage} {fresh(80)}"), (5, f"{fresh(80)} {passage} {fresh(80)}"), (6, f"{fresh(50)} {item} {fresh(50)}"), (7, fresh(150)), (8, fresh(150))]
    docs = _docs(spark, rows).select(*NAMES)
    one = common.written(simhash_dedup.stage(spark, docs, sf))
    assert {r.doc_id for r in one.collect()} == {1, 4, 5, 6, 7, 8}
    two = common.written(suffix_dedup.stage(spark, one, sf))
    text = {r.doc_id: r.text for r in two.collect()}
    assert passage in text[4] and passage[50:-50] not in text[5] and {d: text[d] for d in (1, 7, 8)} == {d: t for d, t in rows if d in (1, 7, 8)}
    three = {r.doc_id: r.text for r in decontaminate.stage(spark, two, sf).collect()}
    assert set(three) == {1, 4, 5, 7, 8} and all(three[d] == text[d] for d in three)


def test_tables_are_removed(spark):
    a = common.written(spark.range(5))
    path = a._written_to
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = lambda: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))
    assert there()
    common.discard(a)
    assert not there()


def test_oracles_name_queries():
    assert set(queries.oracle_sql()) <= set(queries.queries())

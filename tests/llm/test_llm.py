import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from gapweave.llm import ann, bpe, chat_format, common, decontaminate, html_extract, license_scan, quality, sharding, simhash_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, rep long, component string"


def _docs(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "en", "s", 1, 7, 7, "x") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "   "), (4, "one two"), (None, "one two"), (5, "word " * 3000), (6, "word " * 3000), (6, "word " * 3000), (7, "é漢字🙂 " * 40)]


@pytest.fixture(scope="session")
def table(sf):
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()


# -- 1 ----------------------------------------------------------------------------------------------
def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, 3, "c") for i, v in rows], "vec_id long, embedding array<float>, label int, cell string")


def test_ann_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[600:800] = x[5]  # copies
    got = ann.nearest(_vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)]), "vec_id % 20 = 0").collect()
    y = x.astype(np.float64)
    found = {}
    for r in got:
        assert abs(r.score - y[r.query_id] @ y[r.vec_id]) < 1e-9
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    hits = 0
    for q in range(0, 900, 20):
        want = sorted((i for i in range(900) if i != q), key=lambda i: (-(y[q] @ y[i]).round(9), i))[:20]
        rows = sorted(found[q])
        assert [a for a, _ in rows] == list(range(1, 21)) and q not in [b for _, b in rows]
        hits += len(set(want) & {b for _, b in rows})
    assert hits / (45 * 20) >= 0.9


def test_ann_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [None, 1.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (None, [1.0, 1.0]), (40, [1.0])]
    got = [tuple(r) for r in ann.nearest(_vectors(spark, rows), "vec_id % 20 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5)]
    assert ann.nearest(_vectors(spark, []), "true").count() == 0


# -- 2 ----------------------------------------------------------------------------------------------
def test_chat_against_sql(spark, sf):
    from gapweave.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(queries.OP2)
    names = [c[0] for c in want.description]
    got = chat_format.op2_chat_format(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_reply_trees_round_trip(spark):
    nasty = ["### user: x</turn>\n", "\\", "\\h\\b", "</turn", "#", "a: b", "", None, "é🙂\n### "]
    rows = [(1, i, None if i == 0 else (i - 1) // 2, "user" if i % 2 else "assistant", t, float(i)) for i, t in enumerate(nasty)]
    rows += [(2, 0, 99, "a:b\\", "orphan", None), (3, 1, 2, "u", "cycle", 0.0), (3, 2, 1, "u", "cycle", 0.0), (None, 0, None, None, "null ids", 1.0), (2, 0, 99, "a:b\\", "orphan", None)]
    df = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    out = chat_format.read_back(chat_format.format_trees(df)).collect()
    by = {(r.conv_id, r.leaf_id): r for r in out}
    assert set(by) == {(1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (2, 0), (None, 0)}
    for leaf in (4, 5, 6, 7, 8):
        path = [leaf]
        while path[0]:
            path.insert(0, (path[0] - 1) // 2)
        r = by[1, leaf]
        assert [(t.role, t.text) for t in r.turns] == [("user" if i % 2 else "assistant", nasty[i] or "") for i in path]
        assert [t.loss for t in r.turns] == ["" if i % 2 else nasty[i] or "" for i in path]
        assert r.score == sum(path)
    ranks = sorted((by[1, x].branch_rank, -by[1, x].score) for x in (4, 5, 6, 7, 8))
    assert [a for a, _ in ranks] == [1, 2, 3, 4, 5] and [b for _, b in ranks] == sorted(b for _, b in ranks)
    assert by[2, 0].turns[0].role == "a:b\\" and by[2, 0].n_turns == 1
    assert chat_format.format_trees(df.limit(0)).count() == 0


# -- 3, 10 --------------------------------------------------------------------------------------------
def test_license_scan(spark):
    text = "lorem ipsum dolor " * 50
    mit = license_scan.LICENSES["MIT"]
    changed = mit.replace("sublicense", "sublet")
    rows = [(10, text + mit + text), (11, text + changed), (12, "Released  under the\nMIT license!"), (13, text), (14, mit[: len(mit) // 2]), (15, mit * 2)]
    got = {(r.doc_id, r.license): r for r in license_scan.scan(_docs(spark, ODD + rows)).collect()}
    assert set(got) == {(10, "MIT"), (11, "MIT"), (12, "MIT notice"), (15, "MIT")}
    assert got[10, "MIT"].containment == 1.0 and got[10, "MIT"].first_word == 150 and 0.8 <= got[11, "MIT"].containment < 1
    assert license_scan.scan(_docs(spark, [])).count() == 0


def test_tiling():
    t, i = list(range(1, 11)), list(range(1, 11))
    assert decontaminate.tile(t, i, 3) == [(0, 0, 10)]
    assert sorted(decontaminate.tile([6, 7, 8, 9, 10, 0, 1, 2, 3, 4, 5], i, 3)) == [(0, 5, 5), (6, 0, 5)]  # reordered
    assert decontaminate.tile([1, 2], i, 3) == []
    rng = random.Random(3)
    for _ in range(60):
        a, b = [rng.randint(1, 3) for _ in range(30)], [rng.randint(1, 3) for _ in range(15)]
        tiles = decontaminate.tile(a, b, 3)
        ta = [x for s, _, n in tiles for x in range(s, s + n)]
        tb = [x for _, s, n in tiles for x in range(s, s + n)]
        assert len(ta) == len(set(ta)) and len(tb) == len(set(tb))
        assert all(a[s : s + n] == b[p : p + n] and n >= 3 for s, p, n in tiles)
        for x, y in itertools.product(range(28), range(13)):  # nothing of three is left
            assert a[x : x + 3] != b[y : y + 3] or set(range(x, x + 3)) & set(ta) or set(range(y, y + 3)) & set(tb)


def test_decontamination(spark, sf, table):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu", "z"), (2, None, "z"), (3, "too short", "z")], "item_id long, text string, doc_id string")
    a, b = "alpha beta gamma delta epsilon zeta", "eta theta iota kappa lambda mu"
    rows = [(10, f"x {a} {b} y"), (11, f"{b.upper()}, and then: {a}!"), (12, a), (13, "clean text here")]
    got = {r.doc_id: r for r in decontaminate.contaminated(_docs(spark, ODD + rows), bench).collect()}
    assert set(got) == {10, 11} and got[10].n_tiles == 1 and got[11].n_tiles == 2 and got[11].coverage == 1.0
    assert decontaminate.contaminated(_docs(spark, rows), bench.limit(0)).count() == 0
    # rows are judged one by one: a contaminated row does not take others of its doc_id, or of none, along
    rows += [(13, f"{a} {b}"), (None, f"{a} {b}"), (None, "kept")]
    stay = decontaminate.clean(_docs(spark, ODD + rows), bench)
    assert stay.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(map(str, [(r.doc_id, r.text) for r in stay.collect()])) == sorted(map(str, ODD + [(12, a), (13, "clean text here"), (None, "kept")]))
    assert decontaminate.clean(_docs(spark, rows), bench.limit(0)).count() == len(rows) and decontaminate.clean(_docs(spark, []), bench).count() == 0
    items = duckdb.sql(f"SELECT item_id, text FROM '{sf}/benchmark.parquet'").fetchall()
    words = lambda s: re.findall("[a-z0-9\x80-\U0010ffff]+", s.lower())
    grams = lambda w: set(zip(*[w[k:] for k in range(5)]))
    want = {(d, i) for d, t in table for i, x in items if grams(words(x)) and grams(words(x)) <= grams(words(t or ""))}
    out = {(r.doc_id, r.item_id) for r in decontaminate.op10_decontaminate(spark, sf).collect()}
    assert want and want <= out


# -- 4 ----------------------------------------------------------------------------------------------
def test_quality(spark, sf):
    got = {r.doc_id: r for r in quality.op4_quality(spark, sf).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{sf}/labels.parquet'").fetchall()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for d, r in got.items())
    held = [(got[d].predicted, q) for d, q in labels if got[d].held_out]
    assert np.mean([p == q for p, q in held]) > 0.85


def test_quality_odd_rows(spark):
    lab = spark.createDataFrame([(4, 1), (5, None), (None, 0), (4, 0), (99, 1)], "doc_id long, quality int")
    d = _docs(spark, ODD)
    out = quality.score(d, quality.fit(d, lab)).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert quality.score(d.limit(0), quality.fit(d.limit(0), lab.limit(0))).count() == 0
    assert quality.stage.__doc__


# -- 5 ----------------------------------------------------------------------------------------------
def test_fingerprints_against_spark_hash(spark):
    for t in ("A b C d e f g", "one two", "x " * 50, "É é q r s t"):
        words = [w for w in re.split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) if w]
        sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
        df = spark.createDataFrame([(s,) for s in sh], "s string").selectExpr("xxhash64(s) AS h").collect()
        hs = [r.h & (2**64 - 1) for r in df]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
        assert simhash_dedup.fingerprint(t) == want
    assert simhash_dedup.fingerprint(None) == simhash_dedup.fingerprint(" \n") == 0


@pytest.mark.parametrize("blocks", [None, 6, 7])
def test_links_against_brute_force(spark, blocks, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "TREE_ROWS", 8)  # shards in parts
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    vals = list({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(12)} | {0, 1, 2**64 - 1})
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, i) for i, v in enumerate(vals)], "fp long, rep long")
    comp = {r.node: r.component for r in common.connected_components(simhash_dedup.near_links(df, 4, blocks)).collect()}
    up = list(range(len(vals)))
    for i, j in itertools.combinations(range(len(vals)), 2):
        if (vals[i] ^ vals[j]).bit_count() <= 4:
            a, b = up[i], up[j]
            up = [min(a, b) if x in (a, b) else x for x in up]
    assert [comp.get(i, i) for i in range(len(vals))] == up


def test_simhash_odd_rows(spark):
    out = simhash_dedup.simhash_groups(_docs(spark, ODD)).collect()
    assert len(out) == len(ODD)
    by = {r.doc_id: r for r in out}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16 and by[3].component_id == 1
    assert by[4].component_id == by[None].component_id == 4 and by[6].component_id == 5
    assert simhash_dedup.simhash_groups(_docs(spark, [])).count() == 0


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_components(spark, one_task, monkeypatch):
    monkeypatch.setattr(common, "ONE_TASK", one_task)
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (40, 60), (None, 3), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(e).collect()}
    assert got == {i: 0 for i in range(31)} | {40: 40, 50: 40, 60: 40}
    assert common.connected_components(e.limit(0)).count() == 0


# -- 6 ----------------------------------------------------------------------------------------------
def test_bpe_against_the_library(spark, table, monkeypatch):
    from tokenizers import Tokenizer

    lib, mine = Tokenizer.from_file(bpe.default_path()), bpe.vocabulary(bpe.default_path())
    rng = random.Random(1)
    signs = "abcdefghthinaneraoi   éßΣσςİ漢字ー١½'sdtmvel.!?-<|>\x1c\x85\xa0\t\n🙂éͅ①"
    texts = [t or "" for _, t in table[:60]] + ["".join(rng.choice(signs) for _ in range(n)) + x for n in (0, 1, 9, 90, 900) for x in ("", "<|endoftext|>a", "<|end")] + ["thinaner" * 500, "a" * 3000]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        got = mine.encode(t)
        assert got[0] == " ".join(map(str, ids)) and got[1] == lib.decode(ids, skip_special_tokens=False) and got[2] == len(ids)
    monkeypatch.setattr(bpe, "SEGMENT", 200)
    rows = list(enumerate(texts)) + [(None, None), (1, " \n ")]
    out = bpe.encode(_docs(spark, rows), bpe.default_path(), "lists", long_text=150).collect()
    assert len(out) == len(rows)
    want = sorted((str(lib.encode(t or "", add_special_tokens=False).ids)) for _, t in rows)
    assert sorted(str(r.ids) for r in out) == want
    assert bpe.encode(_docs(spark, []), bpe.default_path()).count() == 0


# -- 7 ----------------------------------------------------------------------------------------------
def test_html(spark):
    page = "<html><head><title>no</title></head><body><div class='wrap'><div>Site %s slogan</div><nav>menu</nav><article><h1>T&eacute; %d</h1><p>A &amp;&lt;b&gt; <b>x</b>\n y<p>B<br>C<div class='ad'>buy</div><script>if (a<b) {}</script></article><div id=comments><p>rude</p></div><footer>f</footer></div>"
    rows = [(i, f"https://h.example/{i}", page % ("our", i)) for i in range(5)] + [(5, None, None), (6, "u", ""), (7, "http://x.y", "just text &copy;"), (8, "http://z.q/1", "<main><p>m</main>tail")]
    rows += [(20 + i, f"http://plain.example/{i}", f"<body><div><p>Join our club</p></div><p>body {i}</p>") for i in range(4)]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html_extract.extract(df).collect()}
    assert got[0] == "Té 0\nA &<b> x y\nB C" and got[5] == got[6] == "" and got[7] == "just text ©" and got[8] == "m"
    assert got[21] == "body 1"  # the recurring box is the site's
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_copies_stay_whole(spark):
    wrapped = "<body><div>Site slogan</div><article><div><section><p>One.</p><p>Two.</p></section><div>Three.</div></div></article></body>"
    bare = "<article><div><div>A long first part of the text.</div><br>More.</div></article>"
    plain = "<body><div><p>First words.</p><p>More words.</p></div></body>"
    pages = [("a", wrapped)] * 3 + [("a", "<article><p>Other.</p></article>")] + [("b", plain)] * 3 + [("c", bare)] * 3 + [("d", wrapped.replace("Two", f"Two {i}")) for i in range(4)]
    df = spark.createDataFrame([(i, f"https://{h}.example/{i}", x) for i, (h, x) in enumerate(pages)], "page_id long, url string, html string")
    got = [r.text for r in html_extract.extract(df).orderBy("page_id").collect()]
    assert got[:3] == ["One.\nTwo.\nThree."] * 3 and got[4:7] == ["First words.\nMore words."] * 3
    assert got[7:10] == ["A long first part of the text.\nMore."] * 3
    assert all(g.startswith(f"One.\nTwo {i}.") for i, g in enumerate(got[10:]))


def test_html_layout_classes():
    for page in (
        "<div class='content no-sidebar'><p>a</p></div>", "<div id='page' class='with-sidebar'><p>a</p></div>", "<article class='post has-comments'><p>a</p></article>",
        "<div id=search-page><article><p>a</p></article></div>", "<article class='promo'><p>a</p></article>", "<div id=sidebar><p>b</p></div><p>a</p>", "<article><p>a</p><div class='post no-js comments'>b</div></article>",
        "<article><p>a</p></article><div id=comments><article class=comment><p>b</p></article></div>",
    ):
        assert [t for t, keep in html_extract.read(page)[0] if keep] == ["a"], page


def test_html_templates_alone(spark, sf):
    """Without any markup rule, counting alone finds the menus and footers of pages like the table's."""
    page = "<!DOCTYPE html><html><head><title>no</title><script>var t='</p>';</script></head><body><nav><ul><li><a href='/a'>Home {h}</a></li><li>News</li></ul></nav><!-- ad --><div class='ad'>buy {i}</div><article><h1>T{i}</h1><p><b>Body {i}.<br><p>More {i}.</p></article><footer>&copy; {h} &middot; imprint</footer></body></html>"
    rows = [(i, f"https://{h}.example/{i}", page.format(h=h, i=i)) for i, h in enumerate(["a"] * 6 + ["b"] * 3 + ["few"])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    alone = {r.page_id: r for r in html_extract.extract(df, markup=False).collect()}
    for i in range(9):
        assert alone[i].text == f"buy {i}\nT{i}\nBody {i}.\nMore {i}." and (alone[i].n_template, alone[i].n_markup) == (3, 0)
    assert alone[9].n_template == 0 and "News" in alone[9].text
    both = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert all(both[i].text == f"T{i}\nBody {i}.\nMore {i}." for i in range(10))
    assert all((both[i].n_template, both[i].n_markup) == ((3, 1) if i < 9 else (0, 4)) for i in range(10))
    # the driver's pages, by a count made here: menus and footers that enough pages of a host share go by counting alone
    sf = sf.replace("sf0.001", "sf0.1")
    raw = duckdb.sql(f"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1), html FROM '{sf}/pages.parquet'").fetchall()
    part = {(p, k): re.search(f"<{k}>(.*?)</{k}>", h, re.S)[1] for p, _, h in raw for k in ("nav", "footer")}
    hosts = {p: h for p, h, _ in raw}
    on, size = Counter((hosts[p], k, x) for (p, k), x in part.items()), Counter(hosts.values())
    got = {r.page_id: r for r in html_extract.op7_html_extract(spark, sf).collect()}
    found = 0
    for p, h, _ in raw:
        want = sum(len(re.findall("<li>", part[p, k])) if k == "nav" else 1 for k in ("nav", "footer") if on[h, k, part[p, k]] >= max(4, 0.02 * size[h]))
        found += want > 0
        assert got[p].n_template >= want
    assert found > 200


def test_html_long_pages():
    """Pages of 1 MB that invite quadratic work are read in seconds, and whole."""
    n = 100_000
    for page, want in (
        ("<div>" * n + "x", 1), ("<div>a" * n, n), ("<a href=\"u>t</a>" * n, None), ("<a href='u>t</a> \"" * n, None), ("<b title=\">\" " * n, None), ("<div>" * n + "</section>" * n + "x", 1), ("<center>" * n + "<li>x" * 100, 100),
        ("<article>" * n + "x", 1), ("</script" * n, None), ("<script></script" * n, 0), ("<!-- " * n, 0), ("<" * n, 1), ("&amp;" * n, 1), ("w " * 500_000, 1), ("<p>w" * n, n),
    ):
        began = time.process_time()
        blocks, spans = html_extract.read(page)
        assert time.process_time() - began < 20, page[:40]
        assert want is None or len(blocks) == want, (page[:40], len(blocks))


def test_html_tokens():
    read = lambda page: [(t, k) for t, k in html_extract.read(page)[0]]
    assert read("a < b <1> c") == [("a < b <1> c", True)]
    assert read("<p title='x > y'>a</p><p title=\"it's\">b") == [("a", True), ("b", True)]
    assert read("<p>a<p title=\"open>b</p><p>c") == [("a", True), ("b", True), ("c", True)]
    assert read("x <![CDATA[1 < 2 & 3]]> y<!DOCTYPE z><?php echo ?>") == [("x 1 < 2 & 3 y", True)]
    assert read("a<script>if (a</script  x>b<textarea>no</textarea>c") == [("a b c", True)]
    assert read("end <p") == [("end <p", True)]


# -- 8 ----------------------------------------------------------------------------------------------
def test_sharding(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "a") for i in range(1003)] + [(7, "a")] * 3 + [(None, "b")], "doc_id long, shard_note string")
    out = sharding.assign(rows, ["doc_id"], 40).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == 1007 and len(sizes) == 40 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    assert sharding.assign(rows.limit(0), ["doc_id"], 40).count() == 0
    # a key with most rows is dealt out; columns of any name pass through, shard and slot give way
    monkeypatch.setattr(sharding, "HOT_LEAST", 20)
    odd = "doc_id long, cell string, at string, place string, piece string, salt string, row string, n string, rank string, hot string, first string, own string, s string, before string, slot string, SHARD string"
    many = spark.createDataFrame([(5 if i < 300 else i, *"abcdefghijklmno") for i in range(900)], odd)
    out = sharding.assign(many, ["doc_id", "slot"], 7).toPandas()
    sizes = out.groupby("shard").size()
    assert len(out) == 900 and sizes.max() - sizes.min() <= 1 and set(out["own"]) == {"k"} and list(out.columns) == [*many.columns[:-2], "shard", "slot"]
    assert all(sorted(g) == list(range(len(g))) for _, g in out.groupby("shard")["slot"])
    assert sorted(out["doc_id"]) == [5] * 300 + list(range(300, 900))
    # only rows above a shard's capacity leave their own shard
    owner, counts = [i % 5 for i in range(50)], {i: i * i % 17 for i in range(50)}
    plan = sharding.plan(counts, owner, 5)
    load = [sum(n for p, n in counts.items() if owner[p] == s) for s in range(5)]
    room = [sum(x["hi"] - x["lo"] for x in plan if x["shard"] == s) for s in range(5)]
    moved = sum(x["hi"] - x["lo"] for x in plan if owner[x["place"]] != x["shard"])
    assert max(room) - min(room) <= 1 and moved == sum(max(0, a - b) for a, b in zip(load, room))
    slack = sharding.plan(counts, owner, 5, 0.25)
    assert sum(x["hi"] - x["lo"] for x in slack) == sum(counts.values())


# -- 9 ----------------------------------------------------------------------------------------------
def _brute(rows, width=100):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = b"\1" * width
            seen.add(w)
        out[d] = (len(b), sum(gone), bytes(x for x, r in zip(b, gone) if not r))
    return out


@pytest.mark.parametrize("hot", [False, True, "crowd"])
def test_suffix_dedup(spark, hot, monkeypatch, table):
    if hot == "crowd":
        monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    elif hot:
        monkeypatch.setattr(suffix_dedup, "HOT_LEAST", 30)
        monkeypatch.setattr(suffix_dedup, "HOT_SHARE", 10**8)
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = [(i, "".join(rng.choice("xyz") for _ in range(rng.randint(0, 40))) + line[: rng.randint(60, 260)] + str(i)) for i in range(100, 180)]
    rows += [(1, None), (2, ""), (3, "a" * 700), (4, "ab" * 300), (None, line + "q"), (5, "é漢" * 90), (6, "é漢" * 90)] + [(1000 + d, t) for d, t in table[:60]]
    again = rows[:30] + rows[-30:]  # repeated rows are one document
    out = suffix_dedup.suffix_dedup(_docs(spark, rows + again)).collect()
    assert len(out) == len(rows) + len(again)
    got = {r.doc_id: (r.n_bytes, sum(s.stop - s.start for s in r.spans), bytes(r.kept)) for r in out}
    assert got == _brute(rows) and all(got[r.doc_id][2] == bytes(r.kept) for r in out)
    assert suffix_dedup.suffix_dedup(_docs(spark, [])).count() == 0


def test_long_slabs(monkeypatch):
    rng = random.Random(8)
    text = bytes(rng.choice(b"abc") for _ in range(5000))
    want = {(int(b + f), int(n)): int(h) for _, h, _, f, n, b in [x for s in suffix_dedup.entries([text], 100) for x in zip(*[s[0], s[1], s[2], s[3], s[4], s[5]])]}
    monkeypatch.setattr(suffix_dedup, "SLAB", 700)
    cut = [x for s in suffix_dedup.entries([text], 100) for x in zip(*s[:6])]
    cover = sorted((int(b + f), int(b + f + n)) for _, _, _, f, n, b in cut)
    assert cover[0][0] == 0 and cover[-1][1] == 4901 and all(a[1] == b[0] for a, b in zip(cover, cover[1:]))
    whole = {p: h for (s, n), h in want.items() for p in range(s, s + n)}
    assert all(whole[p] == int(h) for _, h, _, f, n, b in cut for p in range(int(b + f), int(b + f + n)))


# -- pipeline ---------------------------------------------------------------------------------------
def test_pipeline(spark, sf, table):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = docs.columns, None
    for name, stage in corpus_pipeline.STAGES:
        out = common.written(stage(spark, docs, sf))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == names
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept is None or ids <= kept
        kept, docs = ids, out
    assert len(kept) > 0.6 * len(table)
    again = {r.doc_id: hashlib.sha256(str(r.ids).encode()).hexdigest() for r in corpus_pipeline.run(spark, sf).collect()}
    assert again == {r.doc_id: hashlib.sha256(str(r.ids).encode()).hexdigest() for r in docs.collect()}


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _groups(texts, least=0.8):
    """Brute force: the number of each text's group, by all pairs."""
    sets, up = [_shingles(t) for t in texts], list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] == sets[j] or both and both >= least * (len(sets[i]) + len(sets[j]) - both):
            a, b = up[i], up[j]
            up = [min(a, b) if x in (a, b) else x for x in up]
    return up


def _near_texts():
    """Texts, and copies of them with replaced words, whose similarity lies on both sides of 0.8."""
    rng = random.Random(11)
    out = []
    for _ in range(25):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(60, 300))]
        out.append(" ".join(words))
        for share in (0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.05):
            out.append(" ".join(w if rng.random() > share else f"x{rng.randint(0, 10**6)}" for w in words))
    return out + ["", "  ", "one two", "One  two", "three"]


@pytest.mark.parametrize("pairs, few, depth", [(8, 256, 3), (0, 0, 2)])
def test_near_dedup_of_crowds(spark, pairs, few, depth, monkeypatch):
    """Copies of one text by replaced words, cut ends and left-out words, and texts that share a long passage: cells are refined."""
    monkeypatch.setattr(simhash_dedup, "PAIRS", pairs)
    monkeypatch.setattr(simhash_dedup, "FEW", few)
    monkeypatch.setattr(simhash_dedup, "DEPTH", depth)
    rng = random.Random(3)
    word = lambda k: f"w{rng.randint(0, k)}"
    base, line = [word(10**6) for _ in range(120)], [word(10**6) for _ in range(60)]
    texts = [" ".join(base)]
    for i in range(70):
        share = rng.choice([0.005, 0.02, 0.03, 0.04])
        texts.append(" ".join(word(10**6) if rng.random() < share else w for w in base))
        texts.append(" ".join(base[: rng.randint(40, 119)]))
        texts.append(" ".join(w for w in base if rng.random() > 0.02))
        texts.append(" ".join(line + [word(10**6) for _ in range(rng.randint(4, 40))]))
        texts.append(" ".join(line[:30] + [word(10**6) for _ in range(rng.randint(1, 6))] + line[30:]))
    kept = sorted(r.doc_id for r in simhash_dedup.stage(spark, _docs(spark, list(enumerate(texts))), "").collect())
    assert kept == sorted(set(_groups(texts)))


def test_near_dedup_stage_against_brute_force(spark):
    texts = _near_texts()
    sets = [_shingles(t) for t in texts]
    near = [len(a & b) / len(a | b) for a, b in itertools.combinations(sets, 2) if a and b and a != b]
    assert sum(0.8 <= x <= 0.95 for x in near) > 20 and sum(0.7 <= x < 0.8 for x in near) > 20
    kept = sorted(r.doc_id for r in simhash_dedup.stage(spark, _docs(spark, list(enumerate(texts))), "").collect())
    assert kept == sorted(set(_groups(texts)))


def test_near_dedup_stage_keeps_one_row_of_a_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, a), (1, b), (2, b), (2, c), (None, c), (None, "only here"), (None, "only here"), (None, a)]
    kept = [(r.doc_id, r.text) for r in simhash_dedup.stage(spark, _docs(spark, rows), "").collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (2, c), (None, "only here")], key=str)


def test_items_shorter_than_a_seed(spark):
    items = spark.createDataFrame([(1, "Deep blue sea"), (2, "whale"), (3, "?!"), (4, "sea the ship"), (5, "deep blue sea")], "item_id long, text string")
    docs = _docs(spark, [(1, "In the deep, BLUE sea; the deep blue sea."), (2, "the whales"), (3, "A whale"), (4, None), (5, "deep blue"), (6, "sea deep"), (7, "?!")])
    got = sorted(map(tuple, decontaminate.contaminated(docs, items).select("doc_id", "item_id", "n_tiles", "n_matched", "n_words", "coverage").collect()))
    assert got == [(1, 1, 1, 3, 3, 1.0), (1, 5, 1, 3, 3, 1.0), (3, 2, 1, 1, 1, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [2, 4, 5, 6, 7]

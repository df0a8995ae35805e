"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import os
import random
import time

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from helpers import cosine_groups, jaccard_groups, top_k
from pyspark.sql import functions as F

from tidemark.llm import (
    html_main,
    jaccard_join,
    licenses,
    masked_lm,
    mixing,
    pivots,
    quality,
    sentencepiece_bpe,
    topk,
    url_filter,
)
from tidemark.llm.components import connected_components

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow")]


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (5, 4), (4, 5), (9, 8), (8, 7), (7, 6)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 5: 4, 7: 6, 8: 6, 9: 6} | {101 + i: 100 for i in range(30)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_urls(spark):
    urls = [
        None, "", "no scheme", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/1", "x://example.com", "ftp://com/#/",
        "http://notexample.com/en/", "http://ads.example.org/", "a://b://c/d", "http://www.example.com:80/en/", "http://é.com/É?",
    ]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, RULES).collect()}
    want = [
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("a.example.com", "/en/x", "example.com/en/", "block"),
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "", None, "allow"), ("com", "/", None, "allow"),
        ("notexample.com", "/en/", "com/", "allow"), ("ads.example.org", "/", None, "block"), ("b:", "//c/d", None, "allow"),
        ("www.example.com:80", "/en/", None, "allow"), ("é.com", "/É", "com/", "allow"),
    ]
    want[6] = ("com", "/", "com/", "allow")
    assert [tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) for i in range(len(urls))] == want
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0
    assert url_filter.filter_urls(pages, []).where("rule IS NOT NULL").count() == 0


def test_url_digest_collisions(tmp_path, monkeypatch):
    """All entries with one digest: the stored strings decide."""
    monkeypatch.setattr(url_filter, "digest", lambda entry: 7)
    path = tmp_path / "list"
    path.write_bytes(url_filter.build_list(RULES, ("ads",)))
    rules, verdicts = url_filter.DigestList(str(path)).judge(["example.com", "x.org", "ads.org"], ["/en/", "/", "/"])
    assert rules == ["example.com/en/", None, None] and verdicts == ["block", "allow", "block"]


def noisy_copies(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for base in range(25):
        text = [rng.choice(words) for _ in range(rng.randint(1, 120))]
        for copy in range(rng.randint(1, 8)):
            t = list(text)
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = f"x{rng.randint(0, 9)}"
            rows.append((len(rows), "  ".join(t).title() if copy % 3 == 0 else "\t".join(t)))
    return rows


@pytest.mark.parametrize("frequent, block", [(32, 256), (2, 4)])
@pytest.mark.parametrize("percent, words", [(85, 4), (80, 5), (80, 1)])
def test_jaccard_groups(spark, monkeypatch, frequent, block, percent, words):
    """With every token rare, and with most tokens frequent and lists cut into many blocks."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "NOISE", 4 if frequent > 2 else 0)
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "SMALL", 8 if block > 4 else 2)
    rows = noisy_copies() + [(900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  b"), (905, "b a"), (None, "a b"),
                             (906, "one two three four five"), (906, "other words altogether are here"), (899, "other words altogether are here")]
    rows.append((907, rows[0][1]))
    rows.append((908, "long " * 3000))
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, component_id int")
    got = sorted((tuple(r) for r in jaccard_join.jaccard_groups(docs, percent, words).collect()), key=str)
    assert got == jaccard_groups(rows, percent, words)


def test_jaccard_open_groups_are_compared_in_few_copies(spark, monkeypatch):
    """Lists of one family with some members that link with nothing: every open pair meets, in few copies."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    size, family, lists = 300, 220, 6
    rows = [(k, d, d, 19, 1) for k in range(lists) for d in range(size) if k == 0 or d % 50 != k]
    members = spark.createDataFrame(rows, "list long, member long, doc long, blocks int, least int")
    dealt = []

    def compared(some):
        dealt.append(some.toPandas())
        kin = some.where(F.col("doc") < family).groupBy("list", "i", "j", "block").agg(F.collect_set("doc").alias("docs"))
        return kin.select(F.array_min("docs").alias("a"), F.explode("docs").alias("b")).where("a != b")

    jaccard_join._settled(members, "list", compared).collect()
    across = dealt[-1]
    assert len(dealt) == 3 and len(across) < 2 * size * lists  # 32,000 rows when every list was dealt to all blocks
    met = set()
    for (_, i, j), group in across.groupby(["list", "i", "j"]):
        left, right = (group.loc[group["block"] == b, "doc"] for b in (i, j))
        met |= {(min(x, y), max(x, y)) for x in left for y in right if x != y}
    assert met >= {(x, y) for y in range(family, size) for x in range(y)}


def test_jaccard_groups_in_parts(spark, monkeypatch):
    """Signatures and members dealt out part after part give the same groups; so do more documents than are broadcast."""
    dealt, settled, sift = [], jaccard_join._settled, jaccard_join.perhaps_matching

    def counted(members, by, compared, most):
        def noted(some):
            dealt.append((by, some.count()))
            return compared(some)

        return settled(members, by, noted, -(-members.count() // 2))

    monkeypatch.setattr(jaccard_join, "ROUNDS", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "_settled", counted)
    monkeypatch.setattr(jaccard_join, "perhaps_matching", lambda big, keys, key: sift(big, keys, key, 2))
    rows = [*noisy_copies(), (None, "a b"), (903, "a b"), (904, "A  b"), (905, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard_join.jaccard_groups(docs, 80, 5).collect()), key=str)
    assert got == jaccard_groups(rows, 80, 5)
    assert sum(by == "list" for by, _ in dealt) > 3


def test_stored_tables_leave_no_shuffle_files(spark):
    from tidemark.llm import common

    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()

    def files():
        return {f for top in folders for _, _, names in os.walk(str(top)) for f in names if f.startswith("shuffle_")}

    setting, before = spark.conf.get(common.CLEANUP), files()
    kept = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if files() <= before:
            break
        time.sleep(0.1)
    assert files() <= before
    assert sorted(tuple(r) for r in kept.collect()) == [(k, 143 if k < 6 else 142) for k in range(7)]
    assert spark.conf.get(common.CLEANUP) == setting


def test_matching_more_keys_than_are_broadcast(spark):
    """Only rows whose key may be among the keys are dealt out; null keys match nothing."""
    from tidemark.llm import common

    rows = [(i % 2000 if i % 11 else None, f"text {i}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = spark.createDataFrame([(k,) for k in [*range(0, 2000, 10), -5, 1 << 60]], "doc_id long")
    among = sorted((r for r in rows if r[0] is not None and r[0] % 10 == 0), key=str)
    for most in (10, 1000):
        semi = common.matching(docs, keys, "doc_id", "left_semi", most)
        anti = common.matching(docs, keys, "doc_id", "left_anti", most)
        assert semi.columns == anti.columns == docs.columns
        assert sorted(map(tuple, semi.collect()), key=str) == among
        assert sorted([*map(tuple, anti.collect()), *among], key=str) == sorted(rows, key=str)
        perhaps = common.perhaps_matching(docs, keys, "doc_id", most)
        found = sorted(map(tuple, perhaps.collect()), key=str)
        assert set(among) <= set(found) and len(found) < len(among) + 0.15 * len(rows)
        assert "SortMergeJoin" not in perhaps._jdf.queryExecution().toString()
    none = keys.where("doc_id < -9")
    assert common.matching(docs, none, "doc_id", "left_semi", -1).count() == 0
    assert common.matching(docs, none, "doc_id", "left_anti", -1).count() == len(rows)


def test_pipeline_keeps_one_table_between_stages(spark, tmp_path, monkeypatch):
    """A stage's table goes when the next one is written; the last stage's input stays for its result."""
    spark.createDataFrame([(i, "a b") for i in range(9)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    step = ("less", lambda spark, docs, sf_dir: docs.where(F.col("doc_id") < docs.count() - 1))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [step] * 4)
    written, write = [], corpus_pipeline.stored

    def noted(df, name):
        written.append(write(df, name))
        return written[-1]

    monkeypatch.setattr(corpus_pipeline, "stored", noted)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == list(range(5))
    assert [os.path.exists(df.stored_at.removeprefix("file://")) for df in written] == [False, False, True]


def test_idle_encoder_is_dropped(monkeypatch):
    monkeypatch.setattr(sentencepiece_bpe, "IDLE", 0.2)
    with open(MODEL, "rb") as f:
        model = f.read()
    with sentencepiece_bpe.lent_encoder(model) as first:
        assert len(first.encode("a word"))
    with sentencepiece_bpe.lent_encoder(model) as second:
        time.sleep(0.5)
        assert second is first and sentencepiece_bpe._ENCODERS
    for _ in range(50):
        time.sleep(0.1)
        if not sentencepiece_bpe._ENCODERS:
            break
    assert not sentencepiece_bpe._ENCODERS


def test_jaccard_empty(spark):
    assert jaccard_join.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("percent", [70, 80, 85, 95])
def test_signatures_meet(percent):
    """Linked sets share a signature whatever the frequencies of their tokens."""
    rng = np.random.default_rng(percent)
    levels = np.zeros(1 << jaccard_join.SKETCH_BITS, np.uint8)
    levels[rng.random(len(levels)) < 0.8] = 100
    for n in [*range(1, 40), 100, 300, 1000]:
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            spare = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            y = np.unique(np.concatenate([x[spare:], rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64)]))
            shared = len(np.intersect1d(x, y))
            if len(y) and 100 * shared >= percent * (len(x) + len(y) - shared) and len(x) != shared + 0.5:
                a, b = (jaccard_join.signatures(s, levels, 50, percent) for s in (x, y))
                assert len(np.intersect1d(a, b)) or np.array_equal(x, y)


def test_licences(spark):
    rows = [
        (1, None), (2, ""), (3, "MIT License. mit-license; the mit licenses"), (4, "x " * 5000 + "General\nPublic  LICENSE"),
        (5, "Licensed under the Apache License, Version 2.0"), (6, "Permission hereby is granted free of charge"),
        (7, "Permission is hereby granted, free of charge, to any new person obtaining a copy of this software"), (3, "MIT License"),
    ]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, score int")
    got = licenses.scan_licenses(docs).collect()
    found = [(r["doc_id"], r["n_words"], sorted((m["label"], m["start"]) for m in r["matches"])) for r in got]
    assert found == [
        (1, 0, []), (2, 0, []), (3, 7, [("mit", 0), ("mit", 2)]), (4, 5003, [("gpl", 5000)]),
        (5, 8, [("apache", 3), ("apache-2.0", 3)]), (6, 7, []), (7, 17, [("mit-text", 0)]), (3, 2, [("mit", 0)]),
    ]
    assert [r["score"] for r in got][:3] == [0.0, 0.0, 1.0]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


VECTORS = [(800, [0.0] * 4), (801, None), (802, [1.0, None, 0.0, 0.0]), (803, [float("nan")] * 4), (804, [float("inf")] + [1.0] * 3),
           (805, [1.0, 2.0]), (806, [2.0, 4.0]), (807, []), (None, [1.0] * 4), (808, [1e300] * 4), (809, [1e300] * 4), (820, [1e300, -1e300, 0.0, 0.0])]


@pytest.mark.parametrize("tile, fan", [(4096, 8), (7, 2)])
def test_top_k(spark, monkeypatch, tile, fan):
    monkeypatch.setattr(topk, "TILE", tile)
    monkeypatch.setattr(topk, "FAN", fan)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 4]) for i in range(90)] + VECTORS[:-3]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 5).collect())
    assert got == top_k(rows, 5)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    twice = topk.top_k(df.union(df), F.col("vec_id") % 20 == 0, 5).collect()
    assert sorted(tuple(r) for r in twice) == got


def test_top_k_of_huge_components(spark):
    rows = [(20, [1e12, -1e12]), (1, [1e12, 0.0]), (2, [2e12, 1.0]), (3, [1e300, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 20).collect()
    # All three exceed 64 bits: cut to the largest number, ties go to the smaller id.
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 2**63 - 1) for i in (1, 2, 3)]


@pytest.mark.parametrize("block, small", [(512, 16), (8, 4)])
def test_near_duplicates(spark, monkeypatch, block, small):
    monkeypatch.setattr(pivots, "BLOCK", block)
    monkeypatch.setattr(pivots, "SMALL", small)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=32)]) for i in range(200)]
    rows += [(300 + i, [float(x + 0.1 * y) for x, y in zip(rows[i % 12][1], rng.normal(size=32))]) for i in range(150)]
    rows += [(700, rows[3][1]), (701, rows[3][1]), (701, rows[3][1])] + VECTORS[:-1]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rep", F.lit(1))
    got = pivots.near_duplicates(df).collect()
    odd = {800, 801, 802, 803, 804, 807, None}
    want = cosine_groups(rows, 0.9)
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] not in odd) == want
    assert all(r["n_links"] == 0 and r["component_id"] == r["vec_id"] for r in got if r["vec_id"] in odd)
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_html_blocks():
    def read(page):
        return [b.text for b in html_main.blocks_of(page)]

    assert read(None) == read("") == read("  <p> </p>") == read("<script>var a = '<p>x</p>'") == []
    assert read("a<p>b<p>c <b>d</b>e<br>f</div>g") == ["a", "b", "c de f", "g"]
    assert read("x <script>if (a < b) {'</p>'}</script>y<style>p{}</style><!-- <p>z</p> -->") == ["x y"]
    assert read("<p title='a > b'>1 &lt; 2 &amp; 3&nbsp;&eacute;&#8364; &am") == ["1 < 2 & 3 é€ &am"]
    assert read('<div class="x>a</div><p>b') == ['a', "b"] and read("<p>cut <a hre") == ["cut"]
    assert read("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>d<td>e</table>") == ["a", "b", "c", "d", "e"]
    assert len(read("<div>" * 3000 + "deep" + "</div>x" * 3000)) == 3001


def test_html_pages(spark):
    rng = random.Random(6)

    def words(n):
        return " ".join(rng.choice("river stone cloud paper garden letter winter".split()) for _ in range(n)).capitalize() + "."

    sample = [
        "<nav><ul>" + "".join(f"<li><a href='#'>{words(1)}</a>" for _ in range(4)) + f"</ul></nav><article><h1>{words(4)}</h1>"
        + "".join(f"<p>{words(rng.randint(2, 30))}</p>" for _ in range(rng.randint(1, 8))) + f"</article><footer>{words(3)}</footer>"
        for _ in range(60)
    ]
    net = html_main.train(html_main.lessons(sample))
    pages = ["<nav>Menu</nav><article><h1>Title</h1><p>First one.</p><form>Send</form></article>" * 2, None, "", "<footer>f</footer>"]
    df = spark.createDataFrame([(i, p, "old") for i, p in enumerate(pages)], "page_id long, html string, text string")
    got = [r["text"] for r in html_main.extract_main_text(df, net).orderBy("page_id").collect()]
    assert got == ["Title\nFirst one.\nTitle\nFirst one.", "", "", ""]
    assert html_main.extract_main_text(df.limit(0), net).count() == 0
    assert len(html_main.train_labeller(df.limit(0)).weights()) == 8


def test_lstm_slopes():
    rng = np.random.default_rng(0)
    net = html_main.Labeller.new(0)
    for name in ("wx", "wh", "b"):
        setattr(net, name, [w.astype(float) for w in getattr(net, name)])
    net.out, net.bias = net.out.astype(float), net.bias.astype(float)
    x, mask, y = rng.normal(size=(5, 3, html_main.INPUT)) * 0.3, np.ones((5, 3)), (rng.random((5, 3)) < 0.5) * 1.0
    mask[3:, 1] = mask[1:, 2] = 0

    def loss():
        p = net.label(x, mask)
        return -((y * np.log(p) + (1 - y) * np.log(1 - p)) * mask).sum() / mask.sum()

    for w, g in zip(net.weights(), net.slopes(x, mask, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[at] += 0.01
        up = loss()
        w[at] -= 0.02
        slope = (up - loss()) / 0.02
        w[at] += 0.01
        assert abs(slope - g[at]) < 1e-4


def test_quality_of_odd_texts(spark):
    rng = random.Random(3)
    good = [" ".join(rng.choice(["the", "sun", "and", "moon", "shine", "on", "hills"]) for _ in range(40)).capitalize() + "." for _ in range(300)]
    bad = [" ".join(w + "$$$" for w in g.split()[:30]) for g in good[:100]]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(500, None), (501, ""), (502, "word " * 50_000), (None, "a b c")]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "id long, text string, score int")
    model = quality.train_quality(docs, spark.createDataFrame([(i,) for i in [*range(0, 200), 1, 1, None]], "id long"))
    got = {r["id"]: r["score"] for r in quality.score_quality(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values()) and got[500] == got[501]
    assert min(got[i] for i in range(200, 300)) > max(got[i] for i in range(300, 400))
    assert 0.5 < model.prior < 0.95
    empty = quality.train_quality(docs.limit(0), docs.limit(0).select("id"))
    assert quality.score_quality(docs, empty).where("score = 0.5").count() == len(rows)


def test_mix(spark):
    rows = [(i, f"s{i % 4}", 10 + i % 7) for i in range(200)] + [(300, None, 50), (301, None, 0), (302, "empty", None), (302, "empty", 0), (5, "s1", 15), (400, "big", 9000)]
    sized = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, source string, size long, taken string")
    got = mixing.plan_mix(sized, ["doc_id"]).collect()
    assert len(got) == len(rows)
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        total = sum(r["size"] or 0 for r in own)
        assert all(r["source_size"] == total for r in own)
        assert sum(r["taken"] for r in own) == int(own[0]["target"] + 0.5) <= 2 * total
        assert all(r["taken"] <= 2 * (r["size"] or 0) for r in own)
    assert abs(sum({r["source"]: r["target"] for r in got}.values()) - 1.5 * sum(r["size"] or 0 for r in got)) < 1e-6
    again = mixing.plan_mix(sized.repartition(7), ["doc_id"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    order = mixing.training_order(mixing.plan_mix(sized, ["doc_id"])).collect()
    assert [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert all(0 <= r["position"] <= 1 for r in order) and sum(r["words"] for r in order) == sum(r["taken"] for r in got)
    assert mixing.plan_mix(sized.limit(0), ["doc_id"]).count() == 0
    places = {r.doc_id: (r.position, r.place) for r in mixing.first_places(mixing.plan_mix(sized, ["doc_id"]), "doc_id").collect()}
    copies = sorted((c.position, c.copy, r.doc_id is None, r.doc_id or 0, c.words) for r in got for c in r.copies)
    for doc in {c[3] if not c[2] else None for c in copies}:
        first = next(k for k, c in enumerate(copies) if (None if c[2] else c[3]) == doc)
        assert places.pop(doc) == (copies[first][0], first)
    assert not places


def test_schedule_is_inverted(spark):
    for knots in (((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 2.0), (0.25, 0.0), (0.5, 0.0), (1.0, 3.0))):
        used = np.linspace(0, 1, 101)
        df = spark.createDataFrame([(float(u),) for u in used], "u double")
        times = np.array([r[0] for r in df.select(mixing._time(F.col("u"), (knots,), F.lit(0))).collect()])
        grid = np.linspace(0, 1, 100_001)
        done = np.concatenate([[0], np.cumsum(np.interp((grid[1:] + grid[:-1]) / 2, *zip(*knots)))])
        assert np.abs(np.interp(times, grid, done / done[-1]) - used).max() < 1e-4 and (np.diff(times) >= 0).all()


def test_tokens_of_random_texts():
    with open(MODEL, "rb") as f:
        encoder = sentencepiece_bpe.MergeEncoder(f.read())
    rng = random.Random(4)
    letters, pieces = "abcdeé ▁\n\t  .,$%<>0x9AB漢字ゼ😀ﬁ\u0301aaaa    ----====the of ing tion", list(encoder.ids)
    cases = ["", " ", "  ", " ▁ ", "a" * 500, "▁" * 70, "-" * 100 + " " * 45 + "==", "<s></s><unk><0x0A>", "x" * 3000]
    cases += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(2000)]
    cases += ["".join(rng.choice("ab ") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    cases += ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    for text in cases:
        ids = encoder.library.encode(text)
        assert encoder.encode(text).tolist() == ids
        assert encoder.decode(np.array(ids, np.int32)) == encoder.library.decode(ids)
    for _ in range(500):
        ids = [rng.randrange(3, 32000) for _ in range(rng.randint(1, 6))]
        if "\ufffd" not in encoder.library.decode(ids):
            assert encoder.decode(np.array(ids, np.int32)) == encoder.library.decode(ids)


def test_tokens_of_rows(spark):
    rows = [(1, None), (2, ""), (3, "a\n\nb"), (3, "a\n\nb"), (4, "word " * 20_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    got = sentencepiece_bpe.encode_decode(docs, MODEL).collect()
    assert [(r["doc_id"], r["decoded"]) for r in got] == [(i, t or "") for i, t in rows] and got[0]["ids"] == []
    assert sentencepiece_bpe.encode_decode(docs.limit(0), MODEL).count() == 0


def test_masked_lm(spark, monkeypatch):
    rng = random.Random(5)
    good = ["".join(rng.choice(["ab", "cd", "ef "]) for _ in range(60)) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100, None), (101, ""), (102, "漢"), (0, good[0]), (103, "zyxw" * 3000)]
    rows.append((104, "".join(rng.sample(good[1], len(good[1])))))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_tokens int")
    got = masked_lm.score_documents(docs, rounds=3).collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == [(i, len(t or "")) for i, t in rows]
    scores = {r["doc_id"]: r for r in got}
    assert scores[100]["log_prob"] == scores[101]["log_prob"] == 0 and scores[100]["mean_log_prob"] is None
    assert scores[104]["mean_log_prob"] < min(scores[i]["mean_log_prob"] for i in range(80))
    monkeypatch.setattr(masked_lm, "CHUNK", 50)
    again = masked_lm.score_documents(docs.repartition(3), rounds=3).collect()
    assert all(abs(r["log_prob"] - scores[r["doc_id"]]["log_prob"]) < 0.02 * abs(r["log_prob"]) + 0.1 for r in again)
    assert masked_lm.score_documents(docs.limit(0)).count() == 0


def test_windows():
    texts = ["abcd é", "", "漢字 x\n😀z", "a" * 50]
    table = np.array([ord(c) for c in "ab cdé"])
    import pyarrow as pa

    got = [w for p, b in masked_lm._stretches(pa.array([*texts, None])) for w in masked_lm.windows(p, b, table).tolist()]
    want = []
    for t in texts:
        s = [0, 0, *(2 + "ab cdé".index(c) if c in "ab cdé" else 1 for c in t), 0, 0]
        for i in range(2, len(s) - 2):
            code = 0
            for d in (-2, -1, 1, 2, 0):
                code = code * 64 + s[i + d]
            want.append(code)
    assert got == want


def test_network_slopes():
    rng, net = np.random.default_rng(0), masked_lm.Network()
    net.weights = [w.astype(float) for w in net.weights]
    codes, weight = rng.integers(0, 1 << 30, 200).astype(np.uint32), rng.random(200)

    def loss():
        return -(net.log_probabilities(codes) * weight).sum() / weight.sum()

    for w, g in zip(net.weights, net.slopes(codes, weight)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        w[at] += 1e-4
        up = loss()
        w[at] -= 2e-4
        slope = (up - loss()) / 2e-4
        w[at] += 1e-4
        assert abs(slope - g[at]) < 1e-5


def test_every_character_has_a_probability_of_its_own(spark, monkeypatch):
    texts = ["ab7c", "", "漢字é", "😀a"]
    table = np.array([ord(c) for c in "abc"])
    import pyarrow as pa

    (points, begins), = masked_lm._stretches(pa.array(texts))
    codes, starts = masked_lm.exact_windows(points, begins, table)
    want = []
    for t in texts:
        split = [[2 + "abc".index(c)] if c in "abc" else [256 + b for b in c.encode()] for c in t]
        for n, own in enumerate(split):
            for k, token in enumerate(own):
                before = [0, 0, *(x for c in split[:n] for x in c), *own[:k]][-2:]
                behind = [*(x for c in split[n + 1 :] for x in c), 0, 0][:2]
                code = 0
                for x in [*before, *behind, token]:
                    code = code * 512 + x
                want.append(code)
    assert codes.tolist() == want
    assert np.diff(starts).tolist() == [sum(1 if c in "abc" else len(c.encode()) for c in t) for t in texts]

    # More than 62 characters; digits are rare and random, so each of them is far from certain, split or not.
    rng = random.Random(8)
    letters = [chr(0x4E00 + i) for i in range(80)]
    rows = [(i, "".join(rng.choice(letters) for _ in range(200))) for i in range(40)]
    rows += [(100 + i, "".join(rng.choice("0123456789") for _ in range(60))) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (masked_lm.CHARACTERS, 40):
        monkeypatch.setattr(masked_lm, "CHARACTERS", most)
        got = {r["doc_id"]: r for r in masked_lm.score_documents(docs, rounds=3).collect()}
        assert all(got[i]["n_tokens"] == len(t) for i, t in rows)
        assert all(got[100 + i]["mean_log_prob"] < -1.5 for i in range(3))


def test_groups_that_end_with_a_batch():
    import pandas as pd

    from tidemark.llm.common import whole_groups

    rows = pd.DataFrame({"a": [1, 1, 2, 2, 2, 3], "b": [0, 0, 5, 5, 6, 6], "v": range(6)})
    for cuts in ([2], [2, 4], [2, 2, 4, 5], [1, 2, 3, 4], [1, 2, 3, 4, 5], []):
        batches = [rows.iloc[i:j] for i, j in zip([0, *cuts], [*cuts, 6])]
        got = list(whole_groups(batches, ["a", "b"]))
        assert pd.concat(got, ignore_index=True).equals(rows)
        seen = [k for g in got for k in set(zip(g["a"], g["b"]))]
        assert len(seen) == len(set(seen)) == 4 and all(len(g) for g in got)


def test_every_word_of_a_block_counts():
    words = [f"w{i}" for i in range(40)]
    one, two = html_main.vectors(html_main.blocks_of(f"<p>{' '.join(words)}<p>{' '.join([*words[:20], 'advert', *words[21:]])}"))
    place = slice(html_main.PATH, html_main.PATH + html_main.WORDS)
    change = (two - one)[place] * 40**0.5
    assert html_main._hashed("advert", html_main.WORDS) != html_main._hashed("w20", html_main.WORDS)
    assert change[html_main._hashed("advert", html_main.WORDS)] == pytest.approx(1, abs=1e-4)
    assert change[html_main._hashed("w20", html_main.WORDS)] == pytest.approx(-1, abs=1e-4)
    assert one[place].sum() == pytest.approx(40**0.5)


def test_html_that_is_not_closed_and_formulas():
    def read(page):
        return [b.text for b in html_main.blocks_of(page)]

    for name in "svg object canvas audio video select template noscript".split():
        assert read(f"<p>a<{name}><p>b<p>c")[-2:] == ["b", "c"]
        assert read(f"<p>a<{name}>x</{name}><p>b") == ["a", "b"]
    assert read("<p>a<script><p>b") == read("<p>a<textarea><p>b") == ["a"]
    assert read("<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds") == ["If x=2 holds"]
    assert read("<p>a<math><mi>x</mi><p>b") == ["ax", "b"]


def test_html_page_in_one_form(spark):
    rng = random.Random(6)

    def words(n):
        return " ".join(rng.choice("river stone cloud paper garden letter winter".split()) for _ in range(n)).capitalize() + "."

    def page(texts):
        return (
            "<nav><ul>" + "".join(f"<li><a href='#'>{words(1)}</a>" for _ in range(4)) + f"</ul></nav><article><h1>{words(4)}</h1>"
            + "".join(f"<p>{t}</p>" for t in texts) + f"</article><footer>{words(3)}</footer>"
        )

    net = html_main.train(html_main.lessons([page([words(rng.randint(2, 30)) for _ in range(rng.randint(1, 8))]) for _ in range(60)]))
    texts = [words(20) for _ in range(5)]
    pages = [f"<body><form method='post'>{page(texts)}</form></body>", page(texts) + "<form><p>Send</p></form>"]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    for r in html_main.extract_main_text(df, net).collect():
        assert r["text"].split("\n")[1:] == texts


@pytest.mark.parametrize("tile", [4096, 7])
def test_top_k_of_repeated_ids(spark, monkeypatch, tile):
    monkeypatch.setattr(topk, "TILE", tile)
    rng = np.random.default_rng(3)
    rows = [(i % 30, [float(x) + i / 64 for x in rng.integers(-2, 3, 4) / 4]) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 8).collect())
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows]
    want = []
    for q in (0, 20):
        pairs = sorted((-int(np.dot(x, y)), i) for j, x in whole if j == q for i, y in whole if i != q)[:8]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(pairs, 1)]
    assert got == want


def test_unclosed_side_elements_refuse_nothing():
    """With every block labelled as main text, only blocks of closed side elements are left out."""

    def text(page):
        blocks = html_main.blocks_of(page)
        return html_main.main_text(blocks, np.ones(len(blocks)))

    article = "<article><p>First words of it.</p><p>Some more of them.</p></article>"
    whole = "First words of it.\nSome more of them."
    for name in ("nav", "aside", "button", "footer", "menu", "dialog"):
        assert text(f"<body><{name}><a>Home</a></{name}>{article}</body>") == whole
        assert text(f"<body><div><{name}><a>Home</a></div>{article}</body>") == "Home\n" + whole
        assert text(f"<body><{name}>{article}</body>") == whole
        assert text(f"<body><{name}>{article}</{name}></body>") == whole  # it holds the whole page
        assert text(f"<{name}><p>Home</p><{name}>At</{name}>{article}") == "Home\n" + whole
    assert text(f"<dialog open><nav>Home</nav>{article}</dialog>") == whole
    assert text("<nav>") == text("</nav>") == text("") == ""


def test_broken_markup_takes_linear_time():
    def seconds(page):
        start = time.perf_counter()
        html_main.blocks_of(page)
        return time.perf_counter() - start

    for part in ("<svg>", "<svg><canvas>x", "<div>x<p></b></i></foo>", "<nav>x", "</nav></p>x<section>"):
        seconds(part * 2000)
        assert seconds(part * 16_000) < 40 * max(seconds(part * 2000), 0.005)

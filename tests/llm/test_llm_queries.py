"""The registered queries against their SQL, or against brute force over the same tables."""

import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from compare import connect, differences
from helpers import cosine_groups, jaccard_groups

from tidemark.llm import licenses
from tidemark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


def texts(sf_dir):
    return connect(sf_dir).execute("SELECT doc_id, text FROM documents").fetchall()


def test_licences_equal_a_plain_scan(spark, sf_dir):
    base = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    got = {r["doc_id"]: r for r in QUERIES["op3_license_scan"](spark, sf_dir).collect()}
    for doc_id, text in texts(sf_dir):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(i, name) for name, p in base.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r, starts = got[doc_id], sorted(i for i, _ in places)
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((starts[0], starts[-1]) if starts else (None, None))
        assert r["base_labels"] == ",".join(sorted({n for _, n in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_pages_give_their_article(spark, sf_dir):
    import html

    pages = connect(sf_dir).execute("SELECT page_id, html FROM pages").fetchall()
    got = {r["page_id"]: r for r in QUERIES["op5_html_main_text"](spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for page_id, page in pages:
        body = page.split("<article>", 1)[1].split("</article>")[0].split("<footer>")[0]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?(?:b|br)>", " ", body))
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", b)).split()) for b in blocks]
        assert got[page_id]["text"] == "\n".join(b for b in blocks if b)
        assert got[page_id]["n_chars"] == len(got[page_id]["text"])


def test_quality_on_held_out_documents(spark, sf_dir):
    got = QUERIES["op7_quality_classifier"](spark, sf_dir).collect()
    labels = dict(connect(sf_dir).execute("SELECT doc_id, quality FROM labels").fetchall())
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    good, bad = ([r["score"] for r in held if labels[r["doc_id"]] == q] for q in (1, 0))
    pairs = [(g > b) + (g == b) / 2 for g in good for b in bad]
    assert not pairs or sum(pairs) / len(pairs) > 0.9
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got)
    assert sum(s >= 0.3 for s in good) >= 0.95 * len(good)


def test_tokens_equal_the_library(spark, sf_dir):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in QUERIES["op9_sentencepiece"](spark, sf_dir).collect()}
    for doc_id, text in texts(sf_dir):
        ids = lib.encode(text or "")
        assert got[doc_id]["n_tokens"] == len(ids)
        assert got[doc_id]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_scores_rank_shuffled_text_lower(spark, sf_dir):
    got = QUERIES["op10_masked_lm"](spark, sf_dir).collect()
    assert len(got) == len(texts(sf_dir))
    for r in got:
        assert r["log_prob"] <= 0 and (r["n_tokens"] > 0) == (r["mean_log_prob"] is not None)
    mean = sum(r["log_prob"] for r in got) / sum(r["n_tokens"] for r in got)
    counts = Counter(c for _, t in texts(sf_dir) for c in t or "")
    import math

    total = sum(counts.values())
    alone = sum(n * math.log(n / total) for n in counts.values()) / total
    assert mean > alone + 1  # much better than characters by themselves


def test_pipeline_equals_brute_force(spark, sf_dir):
    """Every stage, judged on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    labels = dict(connect(sf_dir).execute("SELECT doc_id, quality FROM labels").fetchall())
    good = stages["quality classifier"](spark, docs, sf_dir).persist()
    kept = {r["doc_id"] for r in good.select("doc_id").collect()}
    clean = [i for i, q in labels.items() if q == 1]
    assert good.columns == docs.columns and sum(i in kept for i in clean) >= 0.98 * len(clean)
    assert sum(i in kept for i, q in labels.items() if q == 0) <= 0.3 * sum(q == 0 for q in labels.values())

    rows = [(r["doc_id"], r["text"]) for r in good.collect()]
    single = stages["n-gram Jaccard join"](spark, good, sf_dir).persist()
    assert single.columns == docs.columns
    assert {r["doc_id"] for r in single.collect()} == {i for i, n, c in jaccard_groups(rows, 80, 5) if c == i}

    sizes, largest = Counter(), Counter()
    for r in single.collect():
        n = len((r["text"] or "").encode().split())
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    mixed = stages["mixing sources to target weights"](spark, single, sf_dir).persist()
    taken = Counter()
    for r in mixed.collect():
        taken[r["source"]] += len((r["text"] or "").encode().split())
    weights = {s: (5, 2, 1)[n % 3] for n, s in enumerate(sorted(sizes))}
    target, open_, words = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        level = (words - sum(target.values())) / max(1, sum(weights[s] for s in open_))
        over = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in over}
        open_ -= over
        if not over:
            break
    target |= {s: level * weights[s] for s in open_}
    assert mixed.columns == docs.columns
    for s in sizes:
        # Documents stay whole: a source misses its target by half a document at most.
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1

    out = stages["SentencePiece encoding and decoding"](spark, mixed, sf_dir)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r["doc_id"], tuple(lib.encode(r["text"] or ""))) for r in mixed.collect())
    found = out.collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in found) == want and all(r["round_trip"] for r in found)
    assert corpus_pipeline.run(spark, sf_dir).count() == len(found)


def test_searches_find_all_near_vectors(spark):
    """Recall of the index against brute force, for pairs around the least cosine."""
    from tidemark.llm.pivots import near_duplicates

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(500, 64))
    copies = np.repeat(centres, 4, axis=0) + rng.normal(size=(2000, 64)) * rng.uniform(0.1, 0.36, (2000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(copies)]
    got = {r["vec_id"]: r for r in near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = cosine_groups(rows, 0.9)
    assert sum(n for _, n, _ in want) > 1000
    assert sum(got[i]["n_links"] for i, _, _ in want) >= 0.95 * sum(n for _, n, _ in want)
    assert all(got[i]["n_links"] <= n for i, n, _ in want)


def test_templates_hold_their_key_phrases():
    for t in licenses.BASE + licenses.NOTICES:
        assert t.words[t.key_at : t.key_at + len(t.key)] == t.key

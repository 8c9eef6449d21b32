import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import panelcal.llm.search as search_module
from panelcal.llm.search import Best, item_tiles, search, terms, tile_scores

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def slow_terms(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, k):
    split = [(i, slow_terms(t)) for i, t in docs]
    n_docs, total = sum(bool(x) for _, x in split), sum(len(x) for _, x in split)
    out = []
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(slow_terms(t))
    for item, wanted in asked.items():
        df = {t: sum(t in x for _, x in split) for t in wanted}
        found = []
        for i, x in split:
            m = 50 + 50 * len(x) * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * x.count(t) // (1000 * x.count(t) + 20 * m)) for t in wanted if t in x)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = ["Ab", "x1", "größe", "ÀÉ", "ſ", "über", "一二", "z", "q", "İ", " y", "the", "the", "the"] + [f"w{i}" for i in range(60)]
    docs = [(i, r.choice([" ", "-", "\n", "_"]).join(r.choices(words, k=r.choice([0, 1, 3, 3, 30, 200])))) for i in r.sample(range(10000), 250)]
    docs += [(i + 20000, docs[0][1]) for i in range(90)] + [(None, docs[5][1]), (None, docs[0][1]), (30000, None), (30001, ""), (30002, "...!"), (30003, "the Ab " * 30000), (docs[5][0], docs[5][1])]
    items = [(i, " ".join(r.choices(words + ["nowhere"], k=r.choice([1, 4, 40])))) for i in range(30)]
    items += [(50, None), (51, ""), (52, "nowhere at"), (None, "Ab q"), (3, items[3][1]), (4, "one more"), (53, docs[0][1])]
    return docs, items


def tables(spark, docs, items):
    clash = ["n", "term", "tf", "item", "doc", "body", "score", "rank", "at"]
    extra = [F.lit(i).alias(c) for i, c in enumerate(clash)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(6).select("*", *extra)
    return d, spark.createDataFrame(items, "item_id long, text string").select("*", *extra, F.lit(1).alias("doc_id"))


def test_terms_follow_their_definition():
    for text in ("", "a-B c_d", "É È", "x y", "z\x7fz", "A1b2", "\x80\xff", "[a]`b{c}"):
        assert [t.decode() for t in terms(text.encode())] == slow_terms(text)
    assert terms(None) == []


@pytest.mark.parametrize("k", [3, 50])
def test_search_equals_brute_force(spark, k):
    docs, items = corpus(k)
    got = sorted((tuple(r) for r in search(*tables(spark, docs, items), k=k).collect()), key=str)
    assert got == slow(docs, items, k)


def test_blocks_tiles_and_salts_change_nothing(spark, monkeypatch):
    docs, items = corpus(8)
    monkeypatch.setattr(search_module, "BLOCK_PAIRS", 60)
    got = sorted((tuple(r) for r in search(*tables(spark, docs, items), k=7).collect()), key=str)
    assert got == slow(docs, items, 7)


def test_tiles_add_up_whatever_their_width():
    rng = np.random.default_rng(3)
    pairs = np.unique(np.column_stack([rng.integers(0, 600, 3000), rng.integers(0, 900, 3000)]), axis=0)
    w = rng.integers(0, 45000, 900)
    doc, term = np.nonzero(rng.random((70, 900)) < 0.3)
    impact = rng.integers(1, search_module.IMPACT, len(doc))
    dense, q = np.zeros((70, 900), np.int64), np.zeros((900, 600), np.int64)
    dense[doc, term], q[pairs[:, 1], pairs[:, 0]] = impact, w[pairs[:, 1]]
    for tile in item_tiles(pairs, w, 600):
        assert tile.width * search_module.IMPACT * w.max() < 1 << 53 or tile.width == search_module.TILE_TERMS
        for width in (tile.width, 64):
            assert (tile_scores(tile._replace(width=width), doc, term, impact, 70) == (dense @ q)[:, tile.items]).all()


def test_heavy_weights_narrow_the_tile():
    pairs = np.array([[0, t] for t in range(5000)])
    (tile,) = item_tiles(pairs, np.full(5000, 10**7), 1)
    assert tile.width * search_module.IMPACT * 10**7 < 1 << 53 <= (tile.width + 1) * search_module.IMPACT * 10**7
    doc, term = np.zeros(5000, np.int64), np.arange(5000)
    assert tile_scores(tile, doc, term, np.full(5000, 999_999), 1)[0, 0] == 5000 * 999_999 * 10**7


def test_ties_with_the_last_are_kept_until_ids_decide():
    (tile,) = item_tiles(np.array([[0, 0]]), np.array([5]), 1)
    best = Best(1, 3)
    for start in range(0, 4000, 40):
        ids = np.arange(4000 - start, 4000 - start - 40, -1)
        best.add(tile, np.full((40, 1), 7), ids, np.zeros(40, np.int64))
        if start == 400:
            best.settle()
    item, score, none, ids = best.settle()
    assert ids.tolist() == [1, 2, 3] and score.tolist() == [7, 7, 7]


def test_empty_tables(spark):
    docs, items = tables(spark, *corpus(1))
    assert search(docs.limit(0), items).count() == 0
    assert search(docs, items.limit(0)).count() == 0
    assert search(docs, items.where("item_id = 51")).count() == 0
    assert search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]

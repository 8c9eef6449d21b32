import random

import numpy as np

from panelcal.llm.repeats import LENGTH, blind_trie_order, deep_shallow, runs, without_repeats


def slow(texts):
    """Removed runs of each text, by counting every string of LENGTH bytes."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d in data:
        for p in range(len(d) - LENGTH + 1):
            s = d[p : p + LENGTH]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - LENGTH + 1):
            if seen[d[p : p + LENGTH]] > 1:
                gone[p : p + LENGTH] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(int)))
        out.append(([tuple(map(int, e)) for e in edges.reshape(-1, 2)], bytes(b for b, g in zip(d, gone) if not g)))
    return out


def prose(r, n):
    return "".join(r.choice(["the ", "of ", "né ", "then ", "ab", "x", "ou ", ". ", "und "]) for _ in range(n))


def corpus(seed):
    r = random.Random(seed)
    passages = [prose(r, 150), prose(r, 90), prose(r, 75)[:LENGTH], prose(r, 75)[: LENGTH - 1]]
    texts = [prose(r, r.randrange(5, 400)) for _ in range(25)]
    for _ in range(25):
        cut = r.randrange(0, 300)
        texts.append(prose(r, cut) + r.choice(passages) + prose(r, 80) + r.choice(passages)[r.randrange(0, 40) :])
    base = prose(r, 500)
    for _ in range(10):
        at = r.randrange(0, len(base) - 5)
        texts.append(base[:at] + r.choice(["", "zz", "q"]) + base[at + r.randrange(0, 4) :])
    texts += [texts[0], texts[30], "a" * 700, "a" * 190, "ab" * 300, "the end " * 90, None, "", " "]
    return texts


def test_every_window_has_its_least_string_as_anchor():
    data = corpus(1)[40].encode()
    first, count, anchor, _ = runs(data)
    assert first[0] == 0 and (first[1:] == first[:-1] + count[:-1]).all() and count.sum() == len(data) - LENGTH + 1
    assert (anchor >= first + count - 1).all() and (anchor <= first + LENGTH - 32).all()


def test_blind_trie_and_deep_shallow_sort():
    r = random.Random(2)
    strings = list({bytes(r.choice(b"ab\x00\xff") for _ in range(16)) for _ in range(500)} | {b"a" * 15 + bytes([i]) for i in range(50)})
    assert [strings[i] for i in blind_trie_order(strings)] == sorted(strings)
    rows = [bytes(r.choice(b"ab") if k > 40 else 97 for k in range(64)) for _ in range(400)] + [bytes(r.choice(b"ab") for _ in range(64)) for _ in range(400)]
    rows += rows[:50]
    words = np.frombuffer(b"".join(rows), ">u8").astype(np.uint64).reshape(-1, 8)
    groups = np.array([r.randrange(3) for _ in rows])
    order, common = deep_shallow(groups, words)
    got = [(groups[i], rows[i]) for i in order]
    assert got == sorted((g, s) for g, s in zip(groups, rows))
    for k in range(1, len(order)):
        (g, a), (h, b) = got[k - 1], got[k]
        assert common[k] == (-1 if g != h else next((i for i in range(64) if a[i] != b[i]), 64))


def test_removed_bytes_are_those_of_repeated_strings(spark, monkeypatch):
    import panelcal.llm.repeats as repeats

    for seed, tile in ((1, 50_000), (2, 3)):
        monkeypatch.setattr(repeats, "TILE", tile)
        texts = corpus(seed)
        rows = [(i if i != 3 else None, t, 7, "x") for i, t in enumerate(texts)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, u int, kept string").repartition(5)
        got = {r.doc_id: r for r in without_repeats(docs).collect()}
        assert len(got) == len(texts)
        for (i, t, u, _), (spans, kept) in zip(rows, slow(texts)):
            r = got[i]
            assert [tuple(s) for s in r.spans] == spans, (i, t)
            assert bytes(r.kept) == kept and r.n_bytes == len((t or "").encode()) and r.n_removed == sum(b - a for a, b in spans) and r.u == u


def test_equal_rows_and_empty_table(spark):
    long = "word " * 60
    docs = spark.createDataFrame([(1, long), (1, long), (2, "short"), (2, "short")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed) for r in without_repeats(docs).collect())
    assert got == [(1, 300), (1, 300), (2, 0), (2, 0)]
    assert without_repeats(docs.limit(0)).count() == 0

import random

import numpy as np
import xxhash

from panelcal.llm.neardup import cell_links, gray_rank, links, with_components
from panelcal.llm.simhash import fingerprint


def slow_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) > 4 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, radius):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a in values:
        for b in values:
            if bin(a ^ b).count("1") <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def corpus(seed, n):
    """Clusters of close fingerprints around random centres, chains included."""
    r = random.Random(seed)
    found = set()
    while len(found) < n:
        v = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 1, 3, 40])):
            found.add(v)
            for _ in range(r.randrange(1, 6)):
                v ^= 1 << r.randrange(64)
    return sorted(found)


def test_fingerprint_follows_its_definition():
    for text in (None, "", " \n", "a", "A b", "a b c d", "a b c d e", "Ünï ÀB c\td e\nf a b c d", "x " * 50):
        assert fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_gray_rank_inverts_the_gray_code():
    i = np.arange(5000, dtype=np.uint64)
    assert (gray_rank(i ^ (i >> np.uint64(1))) == i).all()


def test_index_finds_the_classes_of_all_pairs():
    for seed in range(4):
        values = corpus(seed, 300)
        f = np.array(values, np.uint64)
        a, b = cell_links(np.zeros(len(f), np.int64), f, 4)
        pairs = [(int(x), int(y)) for x, y in zip(a, b)]
        got = {v: v for v in values}
        for _ in values:  # relax
            for x, y in pairs:
                low = min(got[x], got[y])
                got[x] = got[y] = low
        want = classes(values, 4)
        groups = lambda m: sorted(sorted(v for v in m if m[v] == k) for k in set(m.values()))
        assert groups(got) == groups(want)


def test_links_span_cells_and_tiles(spark, monkeypatch):
    import panelcal.llm.neardup as neardup

    values = corpus(9, 500)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    table = spark.createDataFrame([(v,) for v in signed], "fp long")
    want = classes(values, 4)
    for tile in (1 << 16, 7):
        monkeypatch.setattr(neardup, "TILE", tile)
        got = neardup.near_classes(table.selectExpr("fp", "fp as doc_id")).collect()
        groups = {}
        for row in got:
            groups.setdefault(row.component_id, set()).add(row.fp % 2**64)
        expected = {}
        for v, k in want.items():
            expected.setdefault(k, set()).add(v)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert links(table).columns == ["a", "b"]


def test_documents_with_nulls_ties_and_extra_columns(spark):
    long = " ".join(f"w{i % 97}x{i}" for i in range(4000))
    rows = [(5, None, 1), (3, "", 1), (9, " \n ", 2), (7, long, 1), (2, long + " tail", 1), (2, long, 3), (None, "alone here", 1), (11, "a b", 1), (12, "A  B", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted((tuple(r) for r in with_components(docs).collect()), key=str)
    assert len(got) == len(rows)
    by = {}
    for i, f, c in got:
        by.setdefault(i, set()).add((f, c))
    assert by[5] == by[3] == by[9] == {("0" * 16, 3)}
    assert {c for _, c in by[7] | by[2]} == {2}
    assert by[11] == by[12] and {c for _, c in by[11]} == {11}
    assert {c for _, c in by[None]} == {None}
    assert with_components(docs.limit(0)).count() == 0

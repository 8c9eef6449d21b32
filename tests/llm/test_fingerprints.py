import hashlib
import random

import pytest

from panelcal.llm.fingerprints import Fingerprints, edit, edited_pairs, within_radius
from panelcal.llm.queries import op10_simhash_fingerprints


def test_query_against_plain_python(spark, tmp_path):
    r = random.Random(2)
    words = ["the", "Ünd", "of", "strasse", "eau", "🙂"] + [f"w{i}" for i in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 40, 400]))) for _ in range(120)] + [None, "", "a", "ab\n", "x y " * 20_000]
    ids = r.sample(range(10**6), len(texts))
    spark.createDataFrame([(i, t, "z") for i, t in zip(ids, texts)], "doc_id long, text string, fp string").repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op10_simhash_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(zip(ids, texts))
    prints = Fingerprints()
    of = lambda t: prints.of(t.encode())
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 4
        changed = t[: len(t) - cut] + after[:cut]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (f"{of(t):016x}", f"{of(changed):016x}")
        assert x.near_edited == 1 - bin(of(t) ^ of(changed)).count("1") / 64 and x.near_next == 1 - bin(of(t) ^ of(after)).count("1") / 64
    long = [got[i] for i, t in order if t and len(t) > 1000]
    assert sum(x.near_edited for x in long) / len(long) > 0.75 > sum(x.near_next for x in long) / len(long)


def test_fingerprint_by_its_definition():
    import numpy as np
    import xxhash

    from panelcal.llm.common import mix64

    text = b"The cat sat on the extraordinarily long mat the cat"
    words = text.lower().split()
    own = [xxhash.xxh64_intdigest(w, 1) for w in words]
    terms = [(h, min(len(w), 12)) for h, w in zip(own, words)]
    terms += [(int(mix64(np.array([(a * 3 + b) % 2**64], np.uint64))[0]), 4) for a, b in zip(own, own[1:])]
    want = sum(1 << b for b in range(64) if sum(w if h >> b & 1 else -w for h, w in terms) > 0)
    assert Fingerprints().of(text) == want


def test_single_row_equal_ids_nulls_and_empty_table(spark):
    one = spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")
    assert edited_pairs(one).first().edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    rows = [(None, "null id"), (1, "same"), (1, "same"), (1, "other"), (2, None)]
    assert edited_pairs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).count() == 5
    assert edited_pairs(one.limit(0)).count() == 0
    assert edit("abc", "x") == "abc" and edit("abcdefgh", "x") == "abcdefx"


@pytest.mark.parametrize("radius", [0, 3])
def test_block_tables_find_all_within_the_radius(spark, radius):
    r = random.Random(7)
    values = [r.getrandbits(64) for _ in range(60)]
    values += [v ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 6))) for v in values for _ in range(3)]
    signed = [(v - 2**64 if v >> 63 else v,) for v in values] + [(None,), (0,), (0,)]
    table = spark.createDataFrame(signed, "fp long").repartition(4)
    queries = table.limit(40)
    asked, there = {x.fp for x in queries.collect()} - {None}, {v[0] for v in signed} - {None}
    want = {(a, b, bin((a ^ b) % 2**64).count("1")) for a in asked for b in there if bin((a ^ b) % 2**64).count("1") <= radius}
    got = [tuple(x) for x in within_radius(spark.createDataFrame([(a,) for a in asked], "fp long"), table, radius).collect()]
    assert len(got) == len(set(got)) and set(got) == want

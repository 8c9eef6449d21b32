import hashlib
import re

from pyspark.sql import functions as F

from panelcal.llm.exact import copy_groups, without_copies


def slow(rows):
    """(id, keep_id, size, sha) of every row and how many rows are kept, by comparing all texts."""
    whole = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    ids = lambda w: [i for (i, _), x in zip(rows, whole) if x == w and i is not None]
    found = [(i, min(ids(w), default=None), whole.count(w), hashlib.sha256(w.encode()).hexdigest()) for (i, _), w in zip(rows, whole)]
    return sorted(found, key=str), len(set(whole))


def table(spark, rows):
    clash = ["h", "row", "size", "first", "whole", "sha", "kept", "keep_id", "__sha", "__of", "__id", "__h"]
    made = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return made.select("*", *[F.lit(i).alias(c) for i, c in enumerate(clash)])


ROWS = [
    (5, None), (3, ""), (9, " "), (10, "\t\n "), (7, "a b"), (2, "a  \x0b\rb"), (8, "a b "), (None, "alone"), (None, "c"), (4, "c"), (11, "A b"),
    (12, "é x"), (13, "é x"), (6, "same"), (6, "same"), (6, "sa me"), (14, "w " * 40000), (1, "w\n" * 40000), (None, "two"), (None, "two"), (15, "\x00"), (16, "\x00\x00"),
] + [(100 + i, "hot  text") for i in range(40)]


def test_groups_equal_those_of_comparing_all_texts(spark):
    want, groups = slow(ROWS)
    got = copy_groups(table(spark, ROWS)).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == groups == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_texts_of_one_hash_stay_apart(spark):
    """A hash of one digit, which nearly every text shares with others."""
    want, groups = slow(ROWS)
    for weak in (lambda t: F.substring(F.md5(t), 1, 1), lambda t: F.lit("x")):
        got = copy_groups(table(spark, ROWS), digest=weak).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == want
        assert sum(r.kept for r in got) == groups and len({r.text_sha256 for r in got if r.kept}) == groups


def test_rows_that_stay_keep_their_columns(spark):
    docs = table(spark, ROWS)
    left = without_copies(docs)
    assert left.columns == docs.columns
    got = left.collect()
    want = {(k, s) for _, k, _, s in slow(ROWS)[0]}
    digest = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()
    assert sorted(((r.doc_id, digest(r.text)) for r in got), key=str) == sorted(want, key=str)
    assert all((r["h"], r["__sha"], r["__h"]) == (0, 8, 11) for r in got)


def test_empty_table(spark):
    docs = table(spark, ROWS).limit(0)
    assert copy_groups(docs).count() == 0 and without_copies(docs).count() == 0

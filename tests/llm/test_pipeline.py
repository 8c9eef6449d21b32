import random
import re

import corpus_pipeline
from panelcal.llm.neardup import one_per_class
from panelcal.llm.simhash import shingle_hashes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def prose(r, n):
    return " ".join("".join(r.choice(["the", "er", "in", "ou", "st", "an", "tion", "re", "x", "bl"]) for _ in range(r.randrange(2, 5))) for _ in range(n))


def edited(r, text, n):
    words = text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = prose(r, 1)
    return " ".join(words)


def similar(a, b):
    x, y = (set(shingle_hashes((t or "").encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / len(x | y) if x | y else 1.0


def test_one_of_each_class_stays(spark):
    """Kept rows hold no copy of each other, and every row that went is like an earlier one of its class."""
    r = random.Random(3)
    texts = [prose(r, r.choice([3, 8, 60, 300])) for _ in range(60)]
    base = [prose(r, 250) for _ in range(6)]
    texts += [edited(r, b, k) for b in base for k in (0, 1, 2, 3)] + base[:3] * 20 + [None, "", " \n", "one two", "one  two"]
    r.shuffle(texts)
    rows = [(i, t, "en", "s", 5) for i, t in enumerate(texts)] + [(7, texts[7], "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    kept = {x.doc_id: x.text for x in one_per_class(docs).collect()}
    assert one_per_class(docs).count() == len(kept) and set(one_per_class(docs).columns) == set(COLUMNS)
    links = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and similar(a, b) >= 0.8}
    root = list(range(len(texts)))
    for i, j in sorted(links):
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    assert set(kept) == {i for i, x in enumerate(root) if i == x}
    assert all(kept[i] == texts[i] for i in kept)


def corpus(n=160, seed=5):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        t = prose(r, r.randrange(20, 200))
        bad = r.random() < 0.3
        if bad:
            t = t.upper().replace(" ", "!! ")
        elif r.random() < 0.2:
            t += " write to someone.41@mail7.example.com or +1 (366) 555-9807 now"
        rows.append((i, t, "en", "big" if i < 80 else f"s{i % 4}", len(t)))
        labels.append((i, int(not bad), 0))
    rows += [(n + k, rows[k][1], "en", "big", rows[k][4]) for k in range(30)]
    rows += [(n + 100, None, None, None, None), (n + 101, "", "en", "s1", 0), (n + 102, prose(r, 9000), "en", "s2", 1)]
    return rows, labels


def test_stages_on_each_ones_own_input(spark, tmp_path):
    rows, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    quality = {i: q for i, q, _ in labels}
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen.append(docs.collect())
        assert k == 4 or docs.columns == COLUMNS, name
    filtered, distinct, private, mixed, packed = seen
    kept = {x.doc_id for x in filtered}
    assert sum((i in kept) == bool(q) for i, q in quality.items()) / len(quality) > 0.95
    assert len({x.text for x in distinct}) == len(distinct) == len({x.text or "" for x in filtered})
    emails = re.compile(r"\S+@\S+")
    old = {x.doc_id: x.text for x in distinct}
    found = {m for t in old.values() for m in emails.findall(t or "")}
    assert found and all(f not in (x.text or "") for x in private for f in found)
    assert all(x.text == old[x.doc_id] for x in private if not emails.search(old[x.doc_id] or ""))
    assert {x.doc_id for x in mixed} == {x.doc_id for x in private} and {(x.doc_id, x.text) for x in mixed} == {(x.doc_id, x.text) for x in private}
    assert sum(x.piece == 0 for x in packed) == len(mixed)
    total = {}
    for x in packed:
        total[x.sequence_id] = total.get(x.sequence_id, 0) + x.length
    assert max(total.values()) <= 4096


def test_empty_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def classes_left(texts):
    """Positions of the texts that are first in their class of similar texts."""
    root = list(range(len(texts)))
    for i, j in sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and similar(a, b) >= 0.8):
        a, b = root[i], root[j]
        root = [min(a, b) if x in (a, b) else x for x in root]
    return {i for i, x in enumerate(root) if i == x}


def test_copies_of_one_base_meet_it_and_not_only_each_other(spark):
    """Copies are like their base and seldom like each other, so most of the pairs that span a group are no links."""
    r = random.Random(11)
    texts = []
    for _ in range(3):
        base = prose(r, 500)
        texts += [base] + [edited(r, base, 9) for _ in range(40)]
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id for x in one_per_class(docs).collect()}
    assert got == classes_left(texts)


def test_short_copies_are_found(spark):
    """One word more moves the fingerprint of a short text beyond the radius about every other time."""
    r = random.Random(17)
    texts = [t for n in (13, 20, 30, 40) for _ in range(20) for b in [prose(r, n)] for t in (b, b + " " + prose(r, 1))]
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id for x in one_per_class(docs).collect()}
    assert got == classes_left(texts) and len(got) <= 80


def test_many_copies_of_one_base_at_all_similarities(spark):
    """300 copies at similarities of 0.5 to 0.9 to their base, most of them unlike each other."""
    r = random.Random(23)
    base = prose(r, 400)
    texts = [base] + [edited(r, base, r.randrange(4, 27)) for _ in range(300)]
    found = [similar(base, t) for t in texts[1:]]
    assert min(found) < 0.6 and max(found) > 0.85
    r.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert {x.doc_id for x in one_per_class(docs).collect()} == classes_left(texts)


def test_every_pair_is_found_whatever_its_length(spark):
    """Copies at a similarity just above 0.8, by scattered edits and by added passages, from ten to four thousand words."""
    r = random.Random(29)
    texts = []
    for n in (10, 40, 130, 500, 4000):
        for _ in range(12):
            base = prose(r, n)
            grown = base + " " + prose(r, max(1, int(0.24 * (n - 4)) - 1))
            low = base
            for k in range(n):
                more = edited(random.Random(k), base, max(1, int(n * 0.021) - k))
                if similar(base, more) >= 0.8:
                    low = more
                    break
            texts += [base, grown if similar(base, grown) >= 0.8 else base + " end", low]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {x.doc_id for x in one_per_class(docs).collect()}
    assert got == {i for i in range(0, len(texts), 3)}


def test_columns_of_any_name_stay_as_they_are(spark):
    names = ["low", "key", "fp", "distinct", "n", "items", "doc", "body", "id", "stays", "root", "copies", "class", "item", "at", "own"]
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in enumerate(["one two", "one two", None, "three " * 300, "", "three " * 301])]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *names])
    got = one_per_class(docs)
    assert got.columns == docs.columns
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((rows[i] for i in (0, 2, 3)), key=str)


def test_stages_and_operators_keep_columns_of_any_name(spark, tmp_path):
    from pyspark.sql import functions as F

    from panelcal.llm import mixing, repeats

    names = ["share", "first", "k", "idx", "blocks", "served", "low", "fp", "distinct", "packed", "found", "slot", "place", "epoch", "pii", "score", "predicted", "doc", "h", "id", "of", "row", "__row", "at"]
    rows, labels = corpus(60)
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in names])
    made.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    given = {r.doc_id: tuple(r[c] for c in names) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        found = out.collect()
        assert found and all(tuple(r[c] for c in names) == given[r.doc_id] for r in found), name
    kept = [c for c in names if c not in ("slot", "place", "epoch")]
    for r in mixing.mix(docs, mixing.tempered_weights(docs, 0.7), ["doc_id"]).collect():
        assert [r[c] for c in kept] == [v for c, v in zip(names, given[r.doc_id]) if c in kept]
    for r in repeats.without_repeats(docs).collect():
        assert tuple(r[c] for c in names) == given[r.doc_id]

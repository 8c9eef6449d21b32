import random
import zlib

from panelcal.llm import langid, quality
from panelcal.llm.queries import op2_subword_quality, op5_language_mixture


def text(r, lang, n):
    parts = {"en": ["the", "th", "ing", "ou", "er", "and"], "de": ["sch", "ung", "der", "ch", "ü", "ein"], "fr": ["eau", "é", "qu", "oi", "le", "ç"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n))


def documents(n=240, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(["en", "de", "fr"])
        t = text(r, lang, r.randrange(5, 120))
        good = r.random() < 0.7
        if not good:
            t = t.upper().replace(" ", "!! ") if r.random() < 0.5 else " ".join(w for w in t.split()[:4] for _ in range(30))
        rows.append((i, t, lang, int(good)))
    return rows


def test_quality_on_held_out_rows(spark, tmp_path):
    rows = documents()
    extra = [(900, None, None), (901, "", "en"), (902, "\x0b \n", None), (903, "word " * 40_000, "en")]
    spark.createDataFrame([(i, t, lang, 5.0) for i, t, lang, _ in rows] + [(i, t, lang, 1.0) for i, t, lang in extra], "doc_id long, text string, lang string, score double").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, q, 0) for i, _, _, q in rows] + [(None, 1, 0), (901, None, 0), (55_555, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in op2_subword_quality(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [(i, q) for i, _, _, q in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held) and sum(r.held_out for r in got.values()) >= len(held)
    assert sum(got[i].predicted == q for i, q in held) / len(held) > 0.9
    assert got[900].score == got[901].score == got[902].score and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())


def test_scores_depend_on_text_alone_and_odd_tables_work(spark):
    model = quality.train([b"good words here", b"BAD!! BAD!!"] * 20, [1, 0] * 20)
    docs = spark.createDataFrame([(1, "good words here", 3), (2, "BAD!! BAD!!", 4), (1, "good words here", 3)], "doc_id long, text string, predicted int")
    got = quality.with_score(docs, model).collect()
    assert got[0].score == got[2].score > 0.5 > got[1].score
    assert quality.with_score(docs.limit(0), model).count() == 0
    empty = quality.fit(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.with_score(docs, empty).select("score").distinct().collect()[0][0] == 0.5


def test_language_of_held_out_and_mixed_texts(spark, tmp_path):
    rows = documents(300, 5)
    r = random.Random(9)
    mixed = text(r, "de", 60) + " " + text(r, "fr", 40)
    extra = [(900, None, "en"), (901, "", None), (902, "12 !! 34", "de"), (903, mixed, None), (904, text(r, "fr", 30_000), None)]
    spark.createDataFrame([(i, t, lang, "x") for i, t, lang, _ in rows] + [(*e, "y") for e in extra], "doc_id long, text string, lang string, lang_pred string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in op5_language_mixture(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) + len(extra)
    held = [(i, lang) for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].lang_pred == lang for i, lang in held) / len(held) > 0.95
    for i in (900, 901, 902):
        assert (got[i].lang_pred, got[i].score, got[i].languages) == ("und", 0.0, [])
    assert got[903].lang_pred == "de" and set(got[903].languages) == {"de", "fr"} and 0.5 < got[903].score < 0.7
    assert got[904].lang_pred == "fr"
    assert all(0 <= x.score <= 1 for x in got.values())


def test_language_without_anything_learned(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.with_language(docs, langid.fit(docs)).first().lang_pred == "und"
    assert langid.with_language(docs.limit(0), langid.fit(docs.limit(0))).count() == 0


def test_mixture_shares_against_a_plain_loop():
    import numpy as np

    rng = np.random.default_rng(1)
    loglik = np.maximum(rng.normal(size=(50, 3)) * 2, -6)
    full = np.exp(loglik - loglik.max(axis=1, keepdims=True))
    shares = np.full(3, 1 / 3)
    for _ in range(langid.FULL_STEPS):
        part = full * shares
        shares = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
    got = langid.expectation_maximisation(full, np.zeros(50, int), np.full((1, 3), 1 / 3), np.array([0]), langid.FULL_STEPS)
    assert np.allclose(got[0], shares)


def test_long_texts_reach_python_a_few_megabytes_at_a_time(spark):
    """A thousand rows whatever their length, in slices of 4 MB, took an executor beyond its memory."""
    import pyarrow as pa

    from panelcal.llm.common import with_text_columns

    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    docs = spark.range(0, 900, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 2500) AS text")
    made = with_text_columns(docs, lambda: lambda texts: [[sum(map(len, texts))] * len(texts), list(map(len, texts))], "together long, alone long")
    got = made.collect()
    assert max(r.together for r in got) <= 1_000_000 and {r.doc_id: r.alone for r in got} == {i: 2500 * len(f"word{i} ") for i in range(900)}
    seen = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long")
    assert max(r.n for r in seen.collect()) <= 5_000_000


def test_a_batch_is_scored_in_bounded_memory_and_slices_change_no_score():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from panelcal.llm.common import slices

    r = np.random.default_rng(5)
    model = quality.Model(r.random((quality.BUCKETS, 8)).astype(np.float32), r.random((8, 2)).astype(np.float32), np.zeros(2, np.float32))
    texts = pa.array([" ".join(f"w{n}" for n in r.integers(0, 20_000, 800)) for _ in range(900)], pa.string())

    def scores(**limit):
        run = quality.scorer(model)()
        return np.concatenate([run(part)[0] for _, part in slices(texts, **limit)])

    whole = scores(limit=1 << 30)
    tracemalloc.start()
    try:
        got = scores()
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.array_equal(got, whole)
    assert most < 60_000_000

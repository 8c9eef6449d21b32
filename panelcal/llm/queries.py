"""One query per operator, over its whole table; their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcal.llm import exact, fingerprints, langid, mixing, neighbours, packing, pii, quality, repeats, search, whitening
from panelcal.llm.neardup import with_components
from panelcal.llm.sharding import shard_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}



def held_out() -> Column:
    """Documents of this remainder are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 8 shards of equal row counts; only ids, sizes and checksums are shuffled."""
    digest = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard_rows(digest, ["doc_id", "text_crc32", "size"], shards=8, seed=20)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents: 4-word shingles, at most 4 differing bits."""
    return with_components(table(spark, sf_dir, "documents"), words=4, radius=4)


@query
def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a model learned from labelled, not held-out ones."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs.where(~held_out()), table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from text and language of those not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.with_language(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "languages")


#: Key of the pseudonyms in the registered query and the pipeline; a user keeps a secret one.
PII_KEY = b"change me: 32 bytes of secret key"


@query
def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and what was found where."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "text", F.size("pii").alias("n_found"), "pii")


@query
def op10_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text and of the next document, and their likeness."""
    made = fingerprints.edited_pairs(table(spark, sf_dir, "documents"))
    near = lambda other: F.lit(1.0) - fingerprints.distance("fp", other) / F.lit(64.0)
    return made.select(
        "doc_id", "n_chars", "edited_sha256", fingerprints.hexed("fp").alias("fingerprint"), fingerprints.hexed("edited_fp").alias("edited_fingerprint"),
        near("edited_fp").alias("near_edited"), near("next_fp").alias("near_next"),
    )


def tokenizer_path() -> str:
    from public_tokenizers import path

    return path("word_bpe_49k.json")


@query
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized, in sequences of at most 4096 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096)


TEMPERATURE = 0.7

#: The same schedule as a recursion over the slots of a period, in DuckDB.
OP7_SQL = """
WITH RECURSIVE
counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighted AS (SELECT source, n, CAST(round(pow(n, 0.7) * 1000) AS HUGEINT) AS weight FROM counted),
length AS (
  SELECT CAST(greatest(1000, least((sum(weight) + min(weight) - 1) // min(weight), 16 * count(*))) AS BIGINT) AS slots_all FROM weighted),
raw AS (
  SELECT source, n, row_number() OVER (ORDER BY source NULLS FIRST) AS idx, slots_all,
         CAST(weight * slots_all // sum(weight) OVER () AS BIGINT) AS whole, weight * slots_all % sum(weight) OVER () AS rest
  FROM weighted CROSS JOIN length),
floored AS (SELECT source, n, idx, slots_all, greatest(whole, 1) AS share, CASE WHEN whole > 0 THEN rest ELSE -1 END AS rest FROM raw),
lacking AS (
  SELECT *, CAST(slots_all - sum(share) OVER () AS BIGINT) AS lack, CAST(sum(share - 1) OVER () AS BIGINT) AS beyond FROM floored),
taken AS (
  SELECT *, CASE WHEN lack < 0 THEN (share - 1) * -lack // beyond ELSE 0 END AS less,
         CASE WHEN lack < 0 THEN (share - 1) * -lack % beyond ELSE 0 END AS over_
  FROM lacking),
ranked AS (
  SELECT *, CAST(-lack - sum(less) OVER () AS BIGINT) AS more_, row_number() OVER (ORDER BY rest DESC, idx) AS by_rest,
         row_number() OVER (ORDER BY over_ DESC, share DESC, idx) AS by_over
  FROM taken),
shared AS (
  SELECT source, idx, slots_all, (n + 15) // 16 AS blocks,
         CAST(share + CASE WHEN lack >= 0 THEN CASE WHEN by_rest <= lack THEN 1 ELSE 0 END
                           ELSE -less - CASE WHEN by_over <= more_ THEN 1 ELSE 0 END END AS BIGINT) AS share
  FROM ranked),
sizes AS (SELECT list(share ORDER BY idx) AS sizes, any_value(slots_all) AS slots_all FROM shared),
slots AS (
  SELECT CAST(-1 AS BIGINT) AS t, CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT) FOR s IN sizes] AS served, sizes, slots_all FROM sizes
  UNION ALL
  SELECT t + 1, p.i, [CASE WHEN j = p.i THEN served[j] + 1 ELSE served[j] END FOR j IN range(1, len(sizes) + 1)], sizes, slots_all
  FROM (SELECT t, served, sizes, slots_all,
               list_min([{'due': (((served[j] + 1) * slots_all + sizes[j] - 1) // sizes[j]), 'i': j}
                         FOR j IN range(1, len(sizes) + 1) IF served[j] * slots_all // sizes[j] <= t + 1]) AS p
        FROM slots WHERE t < slots_all - 1)),
period AS (SELECT i AS idx, row_number() OVER (PARTITION BY i ORDER BY t) - 1 AS k, t AS slot FROM slots WHERE t >= 0),
horizon AS (
  SELECT max((blocks - 1) // share * slots_all + slot + 1) AS slots
  FROM shared JOIN period ON period.idx = shared.idx AND period.k = (blocks - 1) % share),
broken AS (SELECT idx, count(*) AS more FROM period, horizon, length WHERE slot < slots % slots_all GROUP BY idx),
served AS (
  SELECT source, shared.idx, share, blocks, slots_all, slots // slots_all * share + coalesce(more, 0) AS served
  FROM shared CROSS JOIN horizon LEFT JOIN broken ON broken.idx = shared.idx),
numbered AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents),
turns AS (
  SELECT doc_id, numbered.source, idx, share, slots_all, r, unnest(range(0, (served - 1 - r // 16) // blocks + 1)) AS epoch, blocks
  FROM numbered JOIN served ON numbered.source IS NOT DISTINCT FROM served.source WHERE r // 16 < served)
SELECT doc_id, turns.source, CAST(epoch AS BIGINT) AS epoch,
       CAST((epoch * blocks + r // 16) // share * slots_all + slot AS BIGINT) AS slot, CAST(r % 16 AS INTEGER) AS place
FROM turns JOIN period ON period.idx = turns.idx AND period.k = (epoch * blocks + r // 16) % share
"""


@query
def op7_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents interleaved by source: weights flattened by temperature, blocks of 16 rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, mixing.tempered_weights(docs, TEMPERATURE), by=["doc_id"])


ORACLES["op7_pfair_mix"] = OP7_SQL


@query
def op6_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector, by inner product."""
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


@query
def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes that strings of 200 bytes which also start elsewhere cover."""
    left = repeats.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The same scores as joins of exploded terms, in DuckDB.
OP11_SQL = r"""
WITH
found AS (
  SELECT doc_id, regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
sizes AS (SELECT count(*) FILTER (len(terms) > 0) AS docs, sum(len(terms)) AS total FROM found),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
each AS (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM found),
counted AS (
  SELECT doc_id, n, term, count(*) AS tf FROM each WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM counted CROSS JOIN sizes GROUP BY term),
scored AS (
  SELECT item_id, doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term) CROSS JOIN sizes
  GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


@query
def op11_blocked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents that score highest for each benchmark item, of all documents."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


ORACLES["op11_blocked_search"] = OP11_SQL

OP12_SQL = r"""
WITH whole AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM whole WINDOW g AS (PARTITION BY t)
"""


@query
def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts and whether it is the one that stays."""
    return exact.copy_groups(table(spark, sf_dir, "documents"))


ORACLES["op12_exact_copies"] = OP12_SQL


@query
def op13_chebyshev_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, projected on the 8 leading components of their covariance and scaled to variance 1."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=8)

"""File inventories, registry checks and completeness of stored runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from panelcal.schema import ENTITY

REGISTRY_SCHEMA = (
    "filename string, kind string, expected_bytes bigint, expected_rows bigint, expected_entities bigint, sha256 string"
)
MANIFEST_SCHEMA = (
    "run_id string, experiment string, target string, condition string, seed bigint, revision string, "
    "source string, evaluation_unit string, status string, artifacts map<string,string>"
)
BLOCK = 8 << 20


def _digest(path: str) -> str:
    """SHA-256 of a file of any size in constant memory, through its own file system."""
    from pyarrow import fs

    if path.startswith("file:"):
        system, inner = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@?=&%"))
    total = hashlib.sha256()
    with system.open_input_stream(inner) as stream:
        while block := stream.read(BLOCK):
            total.update(block)
    return total.hexdigest()


def file_name(path: Column | str, depth: int = 1) -> Column:
    """Last ``depth`` parts of a path: part files of different folders may share their name."""
    parts = F.split(path, "/")
    return F.concat_ws("/", F.slice(parts, -depth, depth))


def file_inventory(
    spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, *, depth: int = 1
) -> DataFrame:
    """Path, bytes and SHA-256 of every file below ``path``.

    The listing reads no content. Digests are computed one file per row by streaming, so a file
    beyond the size of a binary column is no special case.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    listed = reader.load([path] if isinstance(path, str) else list(path)).select("path", F.col("length").alias("bytes"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(sha256=[_digest(p) for p in batch["path"]])

    parts = max(spark.sparkContext.defaultParallelism, 2)
    spread = listed.repartition(parts, "path")
    return spread.mapInPandas(digest, "path string, bytes bigint, sha256 string").withColumn(
        "filename", file_name("path", depth)
    )


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Expected size, rows, entities and digest per file, from JSON lines."""
    return spark.read.schema(REGISTRY_SCHEMA).json(path)


def content_counts(parsed: DataFrame, *, depth: int = 1) -> DataFrame:
    """Rows and distinct entities per scanned file (a scan with ``location`` or kept rejects)."""
    return (
        parsed.groupBy(file_name(F.url_decode("file"), depth).alias("filename"))
        .agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(ENTITY).alias("entities"))
    )


def check_registry(registry: DataFrame, files: DataFrame, counts: DataFrame) -> DataFrame:
    """All deviations per registered file, not only the first."""
    joined = registry.join(files.select("filename", "bytes", F.col("sha256").alias("_digest")), "filename", "left").join(
        counts, "filename", "left"
    )

    def off(actual: str, expected: str, text: str) -> Column:
        return F.when(~F.col(actual).eqNullSafe(F.col(expected)), F.lit(text))

    present = F.col("_digest").isNotNull()
    found = F.array_compact(
        F.array(
            F.when(~present, F.lit("missing file")),
            F.when(present, off("bytes", "expected_bytes", "size differs")),
            F.when(present, off("_digest", "sha256", "digest differs")),
            F.when(present, off("rows", "expected_rows", "row count differs")),
            F.when(
                present & F.col("expected_entities").isNotNull(), off("entities", "expected_entities", "entity count differs")
            ),
        )
    )
    return joined.select("filename", "kind", "bytes", "rows", "entities", F.concat_ws("|", found).alias("errors"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Run manifests (JSON lines) below a tree, with the file each came from."""
    return (
        spark.read.schema(MANIFEST_SCHEMA)
        .option("recursiveFileLookup", "true")
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("manifest"))
    )


def declared_artifacts(manifests: DataFrame) -> DataFrame:
    """One row per artifact a manifest declares."""
    return manifests.select("run_id", F.explode(F.map_entries("artifacts")).alias("_a")).select(
        "run_id", F.col("_a.key").alias("artifact"), F.col("_a.value").alias("declared")
    )


def compare_artifacts(declared: DataFrame, observed: DataFrame) -> DataFrame:
    """Declared against observed digests: ok, missing, undeclared or hash_mismatch."""
    both = declared.join(observed, ["run_id", "artifact"], "full_outer")
    state = (
        F.when(F.col("observed").isNull(), "missing")
        .when(F.col("declared").isNull(), "undeclared")
        .when(F.col("declared") != F.col("observed"), "hash_mismatch")
        .otherwise("ok")
    )
    return both.select("run_id", "artifact", state.alias("state"))


def set_digest(rows: DataFrame, tree: Sequence[str], path: str, digest: str) -> DataFrame:
    """One digest per tree over its sorted (path, digest) pairs.

    The definition is one hash over one sorted text, which is sequential per tree. The pairs are sorted by
    Spark, which spills, and hashed one after the other, so no tree is held in memory.
    """
    pair = F.concat(F.col(path), F.lit("\0"), F.col(digest), F.lit("\n"))
    keyed = rows.select(*tree, pair.alias("_pair")).where("_pair is not null")
    schema = T.StructType([*keyed.schema.fields[:-1], T.StructField("members", T.LongType()), T.StructField("set_sha256", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(schema)
        key, members, state = None, 0, hashlib.sha256()
        for batch in batches:
            done = []
            for *k, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if key is not None:
                        done.append((*key, members, state.hexdigest()))
                    key, members, state = k, 0, hashlib.sha256()
                members += 1
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate(types.types)], schema=types)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*key, members, state.hexdigest()), types.types, strict=True)], schema=types)

    return keyed.repartition(*tree).sortWithinPartitions(*tree, "_pair").mapInArrow(fold, schema)


def matrix_gaps(actual: DataFrame, contract: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Run matrix against its contract: missing, unexpected and duplicate cells."""
    keys = list(keys)
    seen = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    missing = contract.select(*keys).distinct().join(seen, keys, "left_anti").withColumn("state", F.lit("missing"))
    extra = seen.join(contract.select(*keys), keys, "left_anti").select(*keys, F.lit("unexpected").alias("state"))
    twice = seen.filter(F.col("_n") > 1).select(*keys, F.lit("duplicate").alias("state"))
    return missing.unionByName(extra).unionByName(twice)


def expected_matrix(
    spark: SparkSession, experiment: str, targets: Sequence[str], conditions: Sequence[str], seeds: Sequence[int]
) -> DataFrame:
    """Every (target, condition, seed) an experiment has to hold."""
    one = spark.range(1).select(F.lit(experiment).alias("experiment"))
    return (
        one.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets])))
        .withColumn("condition", F.explode(F.array(*[F.lit(c) for c in conditions])))
        .withColumn("seed", F.explode(F.array(*[F.lit(int(s)).cast("bigint") for s in seeds])))
    )


def inventory_gaps(indexed: DataFrame, present: DataFrame, key: str = "tree") -> DataFrame:
    """Trees that are indexed but absent, or present but not indexed."""
    missing = indexed.select(key).distinct().join(present, key, "left_anti").withColumn("state", F.lit("missing"))
    extra = present.select(key).distinct().join(indexed, key, "left_anti").withColumn("state", F.lit("unindexed"))
    return missing.unionByName(extra)


def index_contract(index: DataFrame) -> DataFrame:
    """Index rows per experiment against their rules.

    ``index`` holds (experiment, tree, status, revision, targets, conditions, seeds, manifests).
    Exactly one official tree, one revision per tree, and as many manifests as the product of
    targets, conditions and seeds.
    """
    trees = index.groupBy("experiment", "tree").agg(
        F.count_distinct("revision").alias("revisions"),
        F.max("status").alias("status"),
        F.max(F.col("targets") * F.col("conditions") * F.col("seeds")).alias("expected"),
        F.sum("manifests").alias("manifests"),
    )
    return trees.groupBy("experiment").agg(
        (F.count_if(F.col("status") == "OFFICIAL") != 1).alias("official_tree_rule_broken"),
        F.count_if(F.col("revisions") != 1).alias("trees_with_mixed_revisions"),
        F.count_if(F.col("expected") != F.col("manifests")).alias("trees_with_wrong_manifest_count"),
    )


def cell_contract(declared: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Declared cells missing from the store, stored cells nobody declared, and counts by status."""
    keys = list(keys)
    gaps = matrix_gaps(stored, declared, keys).groupBy("state").agg(F.count(F.lit(1)).alias("cells"))
    counted = stored.groupBy(F.concat(F.lit("stored "), F.col("status")).alias("state")).agg(F.count(F.lit(1)).alias("cells"))
    return gaps.unionByName(counted)

import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcal.schema import ContractError
from panelcal.sources import integrity, runs, text

LINE = " ".join(["0.5"] * 3 + [str(i) for i in range(1, 22)])


def write(path, lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_trajectory_file(spark, tmp_path):
    path = write(tmp_path / "train.txt", [f"{e} {c} {LINE} " for e in (1, 2) for c in (1, 2)] + [""])
    rows = text.scan_trajectories(spark, path).collect()
    assert len(rows) == 4 and {r.entity_id for r in rows} == {1, 2}
    assert rows[0].sensor_21 == 21.0 and len(rows[0]) == 26
    prof = text.profile(text.scan_trajectories(spark, path), ["sensor_1", "sensor_2"]).first()
    assert (prof.rows, prof.entities, prof.cycle_min, prof.cycle_max, prof.constant_sensors) == (4, 2, 1, 2, "sensor_1|sensor_2")


@pytest.mark.parametrize(
    "line",
    [f"1 1 {LINE} 7", "1 1 0.5", f"1.5 1 {LINE}", f"0 1 {LINE}", f"1 -1 {LINE}", "1 1 " + LINE.replace("21", "inf"), "1 1 " + LINE.replace("21", "x")],
)
def test_malformed_lines(spark, tmp_path, line):
    path = write(tmp_path / "train.txt", [f"1 2 {LINE}", line])
    with pytest.raises(Exception, match="rejected line"):
        text.scan_trajectories(spark, path).collect()
    assert text.scan_trajectories(spark, path, on_reject="drop").count() == 1
    kept = text.scan_trajectories(spark, path, on_reject="keep").filter("reject is not null").collect()
    assert len(kept) == 1


def test_outcomes_number_lines(spark, tmp_path):
    path = write(tmp_path / "rul.txt", ["5", "", "7", "0"])
    got = {r.entity_id: r.rul for r in text.scan_outcomes(spark, path).collect()}
    assert got == {1: 5, 2: 7, 3: 0}
    panel = spark.createDataFrame([(1,), (2,), (4,)], "entity_id bigint")
    states = {r.entity_id: r.alignment for r in text.align_outcomes(panel, text.scan_outcomes(spark, path)).collect()}
    assert states == {1: "matched", 2: "matched", 3: "no entity", 4: "no outcome"}
    for bad in ("1.5", "-1", "a"):
        broken = write(tmp_path / f"bad{bad}.txt", ["3", bad])
        with pytest.raises(Exception, match="rejected outcome"):
            text.scan_outcomes(spark, broken).collect()


def test_outcome_numbers_survive_many_splits(spark, tmp_path):
    path = write(tmp_path / "long.txt", [str(i % 997) for i in range(20000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        bad = text.scan_outcomes(spark, path).filter((F.col("entity_id") - 1) % 997 != F.col("rul")).count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert bad == 0


def test_text_round_trip_is_bit_exact(spark, tmp_path):
    schema = T.StructType([T.StructField("entity_id", T.LongType()), T.StructField("cycle", T.LongType()), T.StructField("x", T.DoubleType())])
    df = spark.createDataFrame([(1, 1, 0.1 + 0.2), (1, 2, 1e-300), (2, 1, -123456789.123456789)], schema)
    text.write_trajectories(df, str(tmp_path / "out"), ["x"])
    assert sorted(text.scan_trajectories(spark, str(tmp_path / "out"), schema).collect()) == sorted(df.collect())


def test_registry_reports_every_deviation(spark, tmp_path):
    path = write(tmp_path / "a.txt", [f"1 1 {LINE}", f"1 2 {LINE}"])
    content = (tmp_path / "a.txt").read_bytes()
    files = integrity.file_inventory(spark, str(tmp_path), "*.txt")
    row = files.first()
    assert (row.bytes, row.sha256) == (len(content), hashlib.sha256(content).hexdigest())
    counts = integrity.content_counts(text.scan_trajectories(spark, path, on_reject="keep"))
    registry = spark.createDataFrame(
        [("a.txt", "trajectory", len(content), 3, 2, "0" * 64), ("b.txt", "trajectory", 1, 1, 1, "0" * 64)], integrity.REGISTRY_SCHEMA
    )
    errors = {r.filename: r.errors for r in integrity.check_registry(registry, files, counts).collect()}
    assert errors == {"a.txt": "digest differs|row count differs|entity count differs", "b.txt": "missing file"}


def test_out_of_order_rows_across_blocks(spark):
    from panelcal.operators.quality import out_of_order

    rows = spark.createDataFrame(
        [(1, 1, 0, 0), (1, 3, 0, 1), (1, 2, 0, 2), (1, 2, 1, 3), (2, 1, 0, 4), (2, 2, 1, 5)], "entity_id int, cycle int, block int, ordinal int"
    ).withColumn("file", F.lit("f"))
    got = {r.entity_id: r.n_bad for r in out_of_order(rows, "file", "block", "ordinal").collect()}
    assert got == {1: 2, 2: 0}


def test_sinks_refuse_to_overwrite(spark, tmp_path):
    df = spark.createDataFrame([("e", "t", 1, 2.0)], "experiment string, target string, seed int, v double")
    runs.write_run({"metrics": df}, str(tmp_path / "r"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        runs.write_run({"metrics": df}, str(tmp_path / "r"))
    with pytest.raises(ContractError):
        runs.write_table(df, str(tmp_path / "x"), partition_by=["nope"])
    sums = runs.write_report({"metrics": df}, str(tmp_path / "report"))
    assert sums.count() >= 1


def test_no_machine_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from panelcal.schema import ContractError
    from panelcal.session import shared_dir

    conf = SimpleNamespace(get=lambda key, default=None: default)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf))
    with pytest.raises(ContractError):
        shared_dir(cluster)

import zlib

import numpy as np

from panelcal.llm.queries import op1_feistel_shards
from panelcal.llm.sharding import permute, shard_rows


def test_permutation_of_any_size():
    for n in (1, 2, 3, 5, 16, 17, 1000, 65537):
        p = permute(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n))
    big = permute(np.arange(100_000), 10**12, 7)
    assert len(set(big.tolist())) == 100_000 and big.max() < 10**12
    assert (permute(np.arange(1000), 1000, 1) != permute(np.arange(1000), 1000, 2)).any()


def test_rows_law_with_nulls_ties_and_clashing_columns(spark):
    rows = [(None, None, 5), (1, "a", 1), (1, "a", 1), (2, "", 9)] + [(7, "hot", 0)] * 50 + [(i, str(i), 3) for i in range(10, 43)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(7)
    got = shard_rows(df, ["doc_id", "text"], shards=8, seed=3).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = shard_rows(df.repartition(3), ["doc_id", "text"], shards=8, seed=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert shard_rows(df.limit(0), ["doc_id"], 8).count() == 0


def test_query_against_plain_python(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["é" * 3, None, "", "x" * 20_000] * 10)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op1_feistel_shards(spark, str(tmp_path)).collect()}
    place = permute(np.arange(len(rows)), len(rows), 20)
    for i, t in rows:
        data = (t or "").encode()
        r = got[i]
        assert (r["size"], r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", place[i] % 8, place[i] // 8, None)

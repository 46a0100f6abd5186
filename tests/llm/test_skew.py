"""Joins on a hot key are really split by Spark."""

import pytest
from pyspark.sql import functions as F

LOW = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
       "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
       "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def tight(spark):
    for k, v in LOW.items():
        spark.conf.set(k, v)
    yield spark
    for k in LOW:
        spark.conf.unset(k)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_node_with_half_of_the_edges_is_split(tight):
    from pozo.llm.frames import Kept, connected, with_minimum
    e = tight.range(40000).select(F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 9000).alias("u"), (F.col("id") + 10000).alias("v"))
    e = e.repartition(8)
    assert "skew=true" in executed(with_minimum(e, Kept(tight, "test")))
    roots = {r["node"]: r["root"] for r in connected(e, "u", "v").collect()}
    assert roots[10000] == -1 and len(roots) == 40000 + 4500 + 1 and all(roots[i + 10000] == i % 9000 for i in range(1, 40000, 2))


@pytest.mark.parametrize("how", ["inner", "left"])
def test_rows_of_a_frequent_key_are_dealt_to_many_tasks(tight, how):
    from pozo.llm.frames import join_counted
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 1, F.lit(None)).otherwise(1000 + F.col("id") % 9000)
    rows = tight.range(30000).select(key.alias("k"), "id", F.lit("own").alias("c")).repartition(8)
    counted = rows.groupBy("k").agg(F.count("*").alias("_n"), F.max("id").alias("top")).where("_n > 1 and k is not null")
    out = join_counted(rows, counted, ["k"], how, "_n")
    assert out.columns == ["k", "id", "c", "_n", "top"]
    plain = rows.join(counted, "k", how).select(out.columns)
    assert sorted(map(repr, out.collect())) == sorted(map(repr, plain.collect()))
    per_task = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    most = [r["count"] for r in out.where("k = 7").groupBy(F.spark_partition_id()).count().collect()]
    assert sum(most) == 10000 and max(most) < 2600 and max(per_task) < 0.25 * sum(per_task)
    none = join_counted(rows.where("false"), counted.where("false"), ["k"], how, "_n")
    assert none.count() == 0


def test_archives_with_a_member_per_record_and_small_pieces(monkeypatch):
    import gzip

    import pyarrow as pa

    from pozo.llm import warc
    blocks = [b"", b"x" * 70000, "\u00e9\r\n\r\n".encode() * 900, b"WARC/1.1\r\n\r\n"]
    whole = [f"{warc.VERSION}\r\nWARC-Type: response\r\nContent-Length: {len(b)}\r\n\r\n".encode() + b + b"\r\n\r\n" for b in blocks]
    for piece in (1, 7, 1000, 1 << 20):
        monkeypatch.setattr(warc, "PIECE", piece)
        stored = [(gzip.compress(b"".join(whole)), True), (b"".join(map(gzip.compress, whole)), True), (b"".join(whole), False)]
        for data, gz in stored:
            if piece == 1 and not gz:
                continue
            assert [b for _, b in warc._split(warc._inflated(pa.py_buffer(data), gz))] == blocks
        with pytest.raises(ValueError):
            list(warc._split(warc._inflated(pa.py_buffer(stored[0][0][:-20]), True)))
    assert list(warc._split(warc._inflated(pa.py_buffer(b""), True))) == []

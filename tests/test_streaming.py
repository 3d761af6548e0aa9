import pytest
from pyspark.sql import functions as F

from helpers import CHANNELS, random_signal, to_spark
from pulsegrid.operators import features
from pulsegrid.schema import FEATURES
from pulsegrid.streaming import live


def drain(df, name, checkpoint):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_live_features_equal_batch(spark, tmp_path):
    pdf = random_signal(records=2, n=90, gaps=False)
    batch = to_spark(spark, pdf)
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("time_elapsed"))
    stamped = batch.withColumn("ts", ts)
    end = stamped.limit(1).withColumn("record", F.lit("Z")).withColumn("ts", F.timestamp_seconds(F.lit(1_700_009_000)))
    stamped.unionByName(end).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stamped.schema).parquet(str(tmp_path / "in"))
    got = {
        (r.record, r.time.timestamp() - 1_700_000_000): r
        for r in drain(live.live_features(stream), "live_features", str(tmp_path / "c1")).collect()
    }
    want = {(r.record, r.time): r for r in features.window_features(batch).collect()}
    assert got.keys() == want.keys()
    for k, r in want.items():
        for c in [*FEATURES, "label"]:
            assert got[k][c] == (None if r[c] is None else pytest.approx(r[c])), c


def test_live_decisions_trail(spark, tmp_path):
    scores = [round(((i * 37) % 100) / 100, 2) for i in range(60)]
    order = [*range(18), 20, 21, 19, 18, *range(22, 38), 39, 40, 38, *range(41, 60)]  # 18, 19 and 38 come a batch late
    rows = [(rec, i, s, n) for rec in ("A", "B") for n, i in enumerate(order) for s in [scores[i]]] + [("Z", 0, 0.0, 60)]
    table = spark.createDataFrame(rows, "record string, idx bigint, score double, n int")
    ts = F.timestamp_seconds(F.lit(1_700_000_000) + F.when(F.col("record") == "Z", 9000).otherwise(F.col("idx")))
    table = table.withColumn("ts", ts)
    for part in range(4):  # four micro-batches: the state carries over; the last one moves the watermark
        table.where((F.col("n") >= part * 20) & (F.col("n") < part * 20 + 20)).drop("n").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "record string, idx bigint, score double, ts timestamp"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(live.live_decisions(stream, 4, 0.5, ["record"], late="10 seconds"), "live_decisions", str(tmp_path / "c2"))
    table = {(r.record, r.idx): r.pred for r in got.where("record <> 'Z'").collect()}
    assert len(table) == 120 and got.count() in (120, 121)
    for i in range(60):
        assert table["A", i] == table["B", i] == int(sum(scores[max(0, i - 3): i + 1]) / 4 >= 0.5)
    assert CHANNELS

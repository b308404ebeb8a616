"""The streaming features equal the batch ones, whatever the arrival of micro-batches."""

import numpy as np
from pyspark.sql import functions as F

from panelwright.operators.frames import session
from panelwright.sources.derived import panel
from panelwright.streaming.features import stream_bucket_errors, stream_session_features


def arrivals(spark, sf_dir, path):
    df = panel(spark, sf_dir).where("date_id < 4").withColumn("event_time", F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, 0, 0, date_id * 60, seconds_in_bucket)"))
    df = df.select("event_time", "stock_id", "date_id", "seconds_in_bucket", "wap", "target").persist()
    for k, (lo, hi) in enumerate(((0, 30), (30, 60), (60, 100))):
        df.where((F.col("seconds_in_bucket") >= lo) & (F.col("seconds_in_bucket") < hi)).coalesce(1).write.mode("append").parquet(f"{path}/b={k}")
    return df


def run(query, name, tmp_path):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    df = arrivals(spark, sf_dir, str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in") + "/b=*")
    run(stream_session_features(stream, "10 days"), "features", tmp_path)
    keys = ["stock_id", "date_id", "seconds_in_bucket"]
    got = spark.table("features").toPandas().set_index(keys).sort_index()
    ret = lambda k: F.coalesce((F.col("wap") / F.lag("wap", k).over(session()) - 1) * 1e4, F.lit(0.0))
    want = df.withColumn("wap_ret_1b_bps", ret(1)).withColumn("wap_ret_6b_bps", ret(6))
    want = want.withColumn("wap_vol_6b_bps", F.coalesce(F.stddev_samp("wap_ret_1b_bps").over(session().rowsBetween(-5, 0)), F.lit(0.0)))
    want = want.toPandas().set_index(keys).sort_index()[list(got.columns)]
    assert len(got) == len(want) and np.allclose(got.to_numpy(), want.loc[got.index].to_numpy(), atol=1e-9)


def test_windowed_errors(spark, sf_dir, tmp_path):
    df = arrivals(spark, sf_dir, str(tmp_path / "in2"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in2") + "/b=*")
    run(stream_bucket_errors(stream, "1 minute", "0 seconds"), "errors", tmp_path)
    closed = spark.table("errors").agg(F.sum("n")).first()[0]
    assert 0 < closed <= df.where("target is not null").count()

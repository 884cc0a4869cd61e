from __future__ import annotations

from siltstone.streaming import incremental, quota


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return df.sparkSession.sql(f"SELECT * FROM {name}").collect()


def test_quota_state_spans_batches(spark, tmp_path):
    rows = [("a", i, r) for i, r in enumerate(["china_match", "not_china", "china_match", "china_match"])] + [("b", i, "failed") for i in range(3)]
    schema = "key string, queue_pos long, result string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    got = sorted((r["key"], r["queue_pos"], r["outcome"]) for r in run(quota.quota_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2, 2), "quota"))
    assert [o for k, _, o in got if k == "a"] == ["china_match", "not_china", "china_match", "month_quota_met"]
    assert [o for k, _, o in got if k == "b"] == ["failed", "failed", "archive_error_circuit_breaker"]


def test_terminal_rows_come_once(spark, tmp_path):
    df = spark.createDataFrame([("u", "2024-01-01"), ("u", "2024-01-02"), ("v", "2024-01-01")], "url string, at string").selectExpr("url", "to_timestamp(at) AS at")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert sorted(r["url"] for r in run(incremental.once(stream, ["url"], "at"), "once")) == ["u", "v"]


def test_look_back_keeps_the_last_days(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-30",)], "d string").selectExpr("to_timestamp(d) AS at")
    assert incremental.look_back(df, "at", df.selectExpr("max(at)"), 10).count() == 1

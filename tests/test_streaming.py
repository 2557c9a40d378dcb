from tabsight.operators import models as M
from tabsight.streaming import score_stream


def test_score_stream_memory_sink(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 3), int(i % 7 > 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    src = str(tmp_path / "src")
    df.select("k", "a", "b").write.parquet(src)
    model = M.gaussian_nb(df, ["a", "b"], "y")
    stream = spark.readStream.schema("k long, a double, b double").parquet(src)
    q = score_stream(model, stream).writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    got = {r["k"]: r["Predictions"] for r in spark.sql("select * from scored").collect()}
    want = {r["k"]: r["prediction"] for r in model.transform(df).collect()}
    assert got == want


def test_score_micro_batches_idempotent_epochs(spark, tmp_path):
    from tabsight.streaming.scoring import score_micro_batches
    rows = [(i, float(i % 5), float(i % 4), int(i % 5 > 2)) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    src, sink, ckpt = (str(tmp_path / n) for n in ("src", "sink", "ckpt"))
    df.select("k", "a", "b").write.parquet(src)
    model = M.gaussian_nb(df, ["a", "b"], "y")
    stream = spark.readStream.schema("k long, a double, b double").parquet(src)
    q = score_micro_batches(model, stream, sink, ckpt)
    q.processAllAvailable()
    q.stop()
    out = spark.read.parquet(sink)
    assert "batch_id" in out.columns and out.count() == 40
    got = {r["k"]: r["Predictions"] for r in out.collect()}
    want = {r["k"]: r["prediction"] for r in model.transform(df).collect()}
    assert got == want

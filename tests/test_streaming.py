from pyspark.sql import functions as F

from chronoloom.streaming import upsert


def test_upserts_in_epochs(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    schema = "id string, v int, at int"
    for part in ([("a", 1, 1), ("a", 2, 2), ("b", 1, 1)], [("b", 5, 3), ("c", 1, 1)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        upsert.append_versions(stream, out, ["id"], "at", ck).awaitTermination()
    assert sorted((r.id, r.v) for r in upsert.read_latest(spark, out, ["id"]).collect()) == [("a", 2), ("b", 5), ("c", 1)]


def test_windowed_energy_equals_batch(spark, sf, tmp_path):
    src = str(tmp_path / "ev")
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    events.coalesce(1).sortWithinPartitions("t").write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    q = upsert.windowed_energy(stream, "t", "event_type", "value").writeStream.format("memory").queryName("energy").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = upsert.windowed_energy(events, "t", "event_type", "value")
    assert spark.table("energy").exceptAll(batch).count() == 0 == batch.exceptAll(spark.table("energy")).count()

from cairnframe.streaming import leases

REQUESTS = [(1, 1, "acquire", "s1", None, 0), (1, 2, "acquire", "s2", None, 10), (1, 3, "acquire", "s1", None, 20), (1, 4, "renew", "s1", 1, 1000), (1, 5, "acquire", "s2", None, 1300),
            (1, 6, "release", "s1", 1, 1301), (1, 7, "release", "s2", 2, 1302), (1, 8, "acquire", "s3", None, 1303), (2, 9, "renew", "s1", 1, 0)]
SCHEMA = "inode long, seq long, op string, session string, fence long, now long"
EXPECTED = [(1, "acquired", 1), (2, "conflict", 1), (3, "renewed", 1), (4, "renewed", 1), (5, "acquired", 2), (6, "conflict", 2), (7, "released", 2), (8, "acquired", 3), (9, "conflict", 0)]


def test_lease_batch(spark):
    got = leases.lease_batch(spark.createDataFrame(REQUESTS, SCHEMA))
    assert sorted((r.seq, r.outcome, r.fence) for r in got.collect()) == EXPECTED


def test_lease_stream_equals_batch(spark, tmp_path):
    for part in (REQUESTS[:4], REQUESTS[4:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = leases.lease_stream(stream).writeStream.outputMode("append").format("memory").queryName("leases").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("leases").count() == len(REQUESTS)

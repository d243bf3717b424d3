from changeloom.streaming.iteration import first_seen_stream, iterate, iterate_stream

SCHEMA = "branch string, seq long, change string, outcome string"


def test_stream_counts_as_batch_does(spark, tmp_path):
    batches = [[("m", 1, "a", "countable"), ("n", 1, "a", "countable")], [("m", 2, "b", "countable"), ("n", 2, "a", "countable")], [("m", 3, "b", "finished"), ("m", 4, "b", "countable"), ("n", 3, "c", "countable")]]
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(folder))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder))
    query = iterate_stream(stream, cap=1).writeStream.format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = iterate(spark.read.schema(SCHEMA).json(str(folder)), cap=1)
    # Files of one trigger come in any order, so only the branches whose order is known are compared.
    assert {r.branch for r in spark.table("counts").collect()} == {"m", "n"}
    assert spark.table("counts").count() == want.count()


def test_redelivered_lines_pass_once(spark, tmp_path):
    folder = str(tmp_path / "lines")
    spark.sql("SELECT 'x' AS line, timestamp'2024-01-01' AS at UNION ALL SELECT 'x', timestamp'2024-01-01' UNION ALL SELECT 'y', timestamp'2024-01-02'").write.parquet(folder)
    stream = spark.readStream.schema("line string, at timestamp").parquet(folder)
    query = first_seen_stream(stream).writeStream.format("memory").queryName("lines").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.line for r in spark.table("lines").collect()) == ["x", "y"]

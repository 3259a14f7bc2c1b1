from girthkit.streaming.hits import HIT, best, keep_best


def test_stream_keeps_the_best(spark, tmp_path):
    rows = [(f"h{i % 70}", 10 + i % 3, (i * 37) % 101, i % 5, i % 7, i) for i in range(200)]
    log, out = f"file://{tmp_path}/log", f"file://{tmp_path}/out"
    df = spark.createDataFrame(rows, HIT)
    df.repartition(20).write.json(log)
    query = keep_best(spark, log, out, 4)
    query.awaitTermination()
    last = max(int(p.name[2:]) for p in (tmp_path / "out").glob("v=*"))
    got = spark.read.parquet(f"{out}/v={last}").select("order", "graph_hash", "total").collect()
    want = best(df, 4).select("order", "graph_hash", "total").collect()
    assert last >= 2 and sorted(map(tuple, got)) == sorted(map(tuple, want))

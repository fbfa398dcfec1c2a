from tidegraph.streaming import ingest

from test_micro import LINES


def test_stream_counts_and_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text(LINES)
    txs = ingest.stream_transactions(spark, str(tmp_path / "in"), "4000 days")
    q = ingest.stream_chunk_counts(txs).writeStream.format("memory").queryName("chunks").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM chunks").collect()) == [(1, 3, 4), (2, 3, 5), (3, 2, 1), (4, 1, 1)]
    q = ingest.write_chunks(ingest.stream_transactions(spark, str(tmp_path / "in"), "4000 days"), str(tmp_path / "out"), str(tmp_path / "cp2"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9

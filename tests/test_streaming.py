from strandloom.sources.tables import table
from strandloom.streaming import ingest

SF = "/root/testdata/sf0.001"


def test_reads_arrive_once(spark, tmp_path):
    rows = table(spark, SF, "read_pairs")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.deduplicated(ingest.read_stream(spark, str(tmp_path / "in"), rows.schema), "4000 days")
    ingest.write_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = rows.where("trim(seq) <> ''").select("lib_no", "pair_id", "mate").distinct()
    assert got.count() == want.count() == got.select("lib_no", "pair_id", "mate").distinct().count()


def test_daily_counts(spark, tmp_path):
    rows = table(spark, SF, "read_pairs")
    rows.write.parquet(str(tmp_path / "in"))
    q = ingest.daily_counts(ingest.read_stream(spark, str(tmp_path / "in"), rows.schema)).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n_reads) AS n FROM daily").first().n == rows.where("trim(seq) <> ''").count()

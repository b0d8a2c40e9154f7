import pytest
from pyspark.sql import functions as F

from ledgerlight import sources as S
from ledgerlight import streaming


def test_chunks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("a", "text", "hello", None, "X", "2024", "Q1"), ("b", "table", None, "t", "X", "2024", "Q2")], "chunk_id string, chunk_type string, text string, embedding_text string, company string, year string, quarter string")
    S.write_chunks(rows, str(tmp_path / "c"))
    got = S.read_chunks(spark, str(tmp_path / "c")).where("quarter = 'Q2'").collect()
    assert [(r.chunk_id, r.text, r.year) for r in got] == [("b", "t", "2024")]


def test_ground_truth(spark, tmp_path):
    (tmp_path / "g.json").write_text('[{"id": "1"}]\n[{"id": "2", "modality": "pdf"}]')
    assert sorted(r.id for r in S.read_ground_truth(spark, str(tmp_path / "g.json")).collect()) == ["1", "2"]
    (tmp_path / "e.json").write_text("[]")
    with pytest.raises(ValueError, match="no questions"):
        S.read_ground_truth(spark, str(tmp_path / "e.json"))


def test_stream(spark, tmp_path):
    rows = spark.range(20).select(F.col("id"), (F.col("id") % 2).alias("company"), F.lit("t").alias("topic"), F.timestamp_seconds(F.col("id") * 86400).alias("at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streaming.latest_mention(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.id for r in spark.table("latest").collect()) == [18, 19]


def test_kinds(spark):
    nodes = spark.createDataFrame([("Chunk",), ("Table",), ("AudioChunk",), ("Other",), (None,)], "label string")
    got = [(r.source_type, r.chunk_type) for r in S.with_label_kinds(nodes).collect()]
    assert got == [("pdf", "text"), ("pdf", "table"), ("audio", "audio"), ("unknown", "unknown"), ("unknown", "unknown")]
    good = spark.createDataFrame([("text", 1), ("audio", 2), ("text", 3)], "chunk_type string, id int")
    assert {k: sorted(r.id for r in d.collect()) for k, d in S.by_kind(good).items()} == {"text": [1, 3], "table": [], "audio": [2]}
    with pytest.raises(Exception, match="unknown chunk_type: video"):
        S.by_kind(good.union(spark.createDataFrame([("video", 4)], good.schema)))["table"].collect()


def test_summaries_and_roster(spark, tmp_path):
    (tmp_path / "e1").mkdir()
    (tmp_path / "e1" / "benchmark_summary.json").write_text('[{"bucket": "ALL", "hit": 0.5}, {"bucket": "pdf"}]')
    got = S.read_summaries(spark, str(tmp_path), "bucket string, hit double").collect()
    assert sorted((r.experiment, r.bucket, r.hit) for r in got) == [("e1", "ALL", 0.5), ("e1", "pdf", None)]
    assert [r.company for r in S.roster(spark.createDataFrame([("X",), (None,), ("X",)], "company string")).collect()] == ["X"]

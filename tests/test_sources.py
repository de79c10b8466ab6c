"""Files as sources: documents of a folder, and what of them can't be read."""

import hashlib

from pyspark.sql import functions as F

from lodeworks.sources import readers as S
from lodeworks.streaming import ingest as I


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "Report_One.TXT").write_text("Line  one\n\n line two &amp; more\n")
    (tmp_path / "sub" / "page.html").write_text("<html><head><title>The Page</title></head><body><p>" + "words here. " * 40 + "</p></body></html>")
    (tmp_path / "empty.md").write_text(" \n")
    (tmp_path / "scan.bin").write_bytes(b"\x00\x01")
    manifest = spark.createDataFrame([("report_one.txt", "https://x.org/r"), ("other.txt", "n")], "name string, url string")
    docs, issues = S.documents(spark, str(tmp_path), manifest)
    rows = {r.name: r for r in docs.collect()}
    assert set(rows) == {"report_one.txt", "page.html"} and rows["page.html"].title == "The Page" and rows["report_one.txt"].text == "Line one\nline two & more" and rows["report_one.txt"].url == "https://x.org/r"
    assert rows["page.html"].bytes_sha256 == hashlib.sha256((tmp_path / "sub" / "page.html").read_bytes()).hexdigest()
    assert sorted((r.path.rsplit("/", 1)[1], r.issue) for r in issues.collect()) == [("empty.md", "no text"), ("scan.bin", "unknown type")]


def test_headers_and_repeated_ids(spark):
    import pytest

    df = spark.createDataFrame([("1.0", "q", "a"), ("1", "r", "b")], "`Q ID` string, Question string, `Golden Answer` string")
    with pytest.raises(ValueError, match="repeated"):
        S.gold_answers(df, {"q_id": ["q id"], "golden_answer": ["golden answer"]})
    with pytest.raises(ValueError, match="missing columns: golden_answer"):
        S.gold_answers(df.select("Q ID", "Question"), {"q_id": ["q id"]})


def test_new_urls_over_several_batches(spark, tmp_path):
    rows = [("http://X.org/a/?utm_source=f", 1), ("http://x.org/a", 2), ("http://x.org/b", 3)]
    df = spark.createDataFrame(rows, "url string, k int").withColumn("ts", F.expr("timestamp'2031-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, k)"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    for n in range(2):
        df.where(f"k > {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = I.new_urls(I.file_stream(spark, str(tmp_path / "in"), df.schema, 1), "url", "ts")
    stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    assert sorted(r.canonical for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["http://x.org/a", "http://x.org/b"]

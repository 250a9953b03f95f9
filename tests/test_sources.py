import io
import zipfile

from pyspark.sql import functions as F

from folioframe.sources import packages
from folioframe.streaming import diagnostics

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def _docx(body, leave=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for part in packages.REQUIRED:
            if part not in leave:
                z.writestr(part, f'<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>' if part == "word/document.xml" else "<x/>")
    return out.getvalue()


def test_packages_become_paragraphs(spark, tmp_path):
    body = '<w:p><w:pPr><w:pStyle w:val="H1"/><w:numPr><w:ilvl w:val="0"/><w:numId w:val="4"/></w:numPr></w:pPr><w:r><w:t>PART 1</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/>'
    for name, content in {"a.docx": _docx(body), "~$a.docx": b"lock", "bad.docx": b"no zip", "short.docx": _docx(body, ("word/styles.xml",)), "b.txt": b""}.items():
        (tmp_path / name).write_bytes(content)
    parts = packages.parts(packages.files(spark, str(tmp_path))).cache()
    assert {r.path.rsplit("/", 1)[1]: r.fault for r in parts.where("fault IS NOT NULL").collect()} == {"bad.docx": "not_a_package", "short.docx": "missing:word/styles.xml"}
    got = packages.paragraphs(parts).orderBy("paragraph_index").collect()
    assert [(r.text, r.style, r.num_id, r.level, r.in_table) for r in got] == [("PART 1", "H1", "4", "0", False), ("cell", None, None, None, True), ("", None, None, None, False)]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = diagnostics.windowed_counts(diagnostics.event_stream(spark, f"{tmp_path}/in", events), late="3650 days")
    query = stream.writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    want = events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day").start.alias("window_start"), "event_type").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("rolled").collect())) == sorted(map(tuple, want.collect()))

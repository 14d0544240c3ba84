import io
import zipfile

import pytest
from pyspark.sql import functions as F

from vitaeflow.operators import roles
from vitaeflow.operators.dedup import one_per_key
from vitaeflow.sources import files, sinks
from vitaeflow.sources.tables import latest_by_key
from vitaeflow.streaming import resumes

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx():
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    row = "".join(f"<w:tc>{p(t)}</w:tc>" for t in ("a", "a", "b"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}"><w:body>{p("Jo Doe")}{p("")}<w:tbl><w:tr>{row}</w:tr></w:tbl></w:body></w:document>')
    return out.getvalue()


def test_files(spark, tmp_path):
    for name, data in {"a.txt": "﻿Jo\r\n\r\nPython ".encode(), "b.txt": "Zoë".encode("latin-1"), "c.docx": docx(), "d.docx": b"broken", "e.docx": b"broken", "f.jpg": b"x", "g.txt": b"", "h.doc": b"\x01" + "Jane".encode("utf-16-le") + b"\x02plain text\x03", "i.pdf": b"%PDF"}.items():
        (tmp_path / name).write_bytes(data)
    got = {r["filename"]: (r["status"], r["text"], r["error"]) for r in files.extract_texts(files.read_files(spark, str(tmp_path))).collect()}
    assert got["a.txt"] == ("analyzed", "Jo\nPython", None) and got["b.txt"][1] == "Zoë" and got["c.docx"][1] == "Jo Doe\na | b"
    assert got["d.docx"][0] == "failed" and got["e.docx"] == ("duplicate", None, "same as d.docx") and got["f.jpg"][2].startswith("unsupported") and got["g.txt"][2] == "file is empty"
    assert "Jane" in got["h.doc"][1] and "plain text" in got["h.doc"][1] and got["i.pdf"][2] == "no reader for this format"
    assert files.extract_texts(files.read_files(spark, str(tmp_path), "i.pdf"), {".pdf": lambda b: "own reader"}).first()["text"] == "own reader"


def test_csv_and_folder(spark, tmp_path):
    (tmp_path / "p.csv").write_text("pair_id,jd,rater1,rater2\nEXAMPLE_1,x,1,2\np1,x,50,abc\np2,y,500,\np3,z,0,100\n")
    rows = {r["pair_id"]: (r["rater1"], r["rater2"]) for r in files.read_ratings(spark, str(tmp_path / "p.csv"), ["rater1", "rater2"]).collect()}
    assert rows == {"p1": (50.0, None), "p3": (0.0, 100.0)}
    (tmp_path / "c.csv").write_text('Category,Text\nA,"line\none"\nB,\n')
    assert files.read_corpus(spark, str(tmp_path / "c.csv"), "Category", "Text").collect()[0]["text"] == "line\none"
    with pytest.raises(ValueError):
        files.read_corpus(spark, str(tmp_path / "c.csv"), "Category", "Nope")
    (tmp_path / "t.txt").write_text("whole\ntext")
    assert [tuple(r) for r in files.read_folder(spark, str(tmp_path)).collect()] == [("t.txt", "whole\ntext")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "Jo", ["a", "b"])], "id int, name string, skills array<string>")
    sinks.write_csv(df, str(tmp_path / "out"), one_file=True)
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["skills"] == "a; b"
    assert sinks.dossiers(df, "id").first()["json"] == '{"id":1,"skills":["a","b"]}'


def test_latest_and_one_per_key(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 2), (None, "d", 1), (2, None, None)], "k int, s string, r int")
    assert {(r["k"], r["s"]) for r in latest_by_key(df, "k", "r").collect()} == {(1, "c"), (2, None)}
    assert one_per_key(df, "k").count() == 3 and one_per_key(df.limit(0), "k").count() == 0 and one_per_key(df, "k").columns == df.columns


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 10}:00:00", "ab"[i % 2], float(i), f"text {i % 4}") for i in range(40)]
    df = spark.createDataFrame(rows, "id int, at string, kind string, value double, t string").withColumn("ts", F.to_timestamp("at")).drop("at")
    df.write.parquet(str(tmp_path / "in"))
    s = resumes.stream_table(spark, str(tmp_path / "in"), df.schema)
    resumes.run_available(resumes.windowed_counts(s, "ts", "kind"), "counts", str(tmp_path / "c1"), "complete")
    got = {(str(r["start"]), r["kind"]): (r["n"], r["total"]) for r in spark.table("counts").collect()}
    want = {(str(r["start"]), r["kind"]): (r["n"], r["total"]) for r in df.groupBy(F.window("ts", "1 day").alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "kind", "n", "total").collect()}
    assert got == want
    resumes.run_available(resumes.first_copies(s, "t", "ts"), "firsts", str(tmp_path / "c2"))
    assert spark.table("firsts").count() == 4
    resumes.run_available(resumes.sessions(s, "ts", "kind", "2 hours"), "sess", str(tmp_path / "c3"), "complete")
    batch = df.groupBy(F.session_window("ts", "2 hours"), "kind").count()
    assert spark.table("sess").count() == batch.count()
    resumes.run_available(resumes.clean_stream(s, "t"), "clean", str(tmp_path / "c4"))
    assert spark.table("clean").count() == 40


def test_roles(spark):
    texts = {"cook": "kitchen oven soup bread salt", "pilot": "plane airport cloud runway radio", "nurse": "ward patient clinic care shift"}
    rows = [(i, " ".join(w for w in texts[k].split() for _ in range(1 + i % 2)), k) for i in range(60) for k in [list(texts)[i % 3]]]
    df = spark.createDataFrame(rows, "id int, t string, role string")
    model = roles.train_roles(df, "id", "t", "role", features=512)
    top = roles.top_roles(model, df.unionByName(spark.createDataFrame([(99, None, None)], df.schema)), "id", "t", 3)
    by = {}
    for r in top.collect():
        by.setdefault(r["id"], []).append((r["rank"], r["role"], r["probability"]))
    assert len(by) == 61 and all(abs(sum(p for *_, p in v) - 100) < 0.1 for v in by.values()) and all(sorted(by[i])[0][1] == k for i, _, k in rows)
    with pytest.raises(ValueError):
        roles.top_roles(model, df, "id", "t", 0)
    out = df.limit(1).select(roles.without_title_words(F.lit("a Senior Cook and pilot"), ["Senior Cook"]).alias("x")).first()["x"]
    assert "Cook" not in out and "pilot" in out

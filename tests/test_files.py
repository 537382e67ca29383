"""Packages, JSON files, the command line, streams, SQL functions."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from umbra.operators.evaluate import by_type, unmatched
from umbra.operators.report import render
from umbra.operators.verify import digests, residual_values, summary
from umbra.plans import cli
from umbra.plans import fixtures as X
from umbra.plans.redaction import redact_units
from umbra.schema import UNIT
from umbra.sources import docx, jsonio, pdf
from umbra.streaming.local import detect_stream, redact_stream, register

BODY = ["Contact person", "Maya Verlin", "as told by MAYA VERLIN to ann@mail.example", ""]


@pytest.fixture
def package(tmp_path):
    (tmp_path / "in").mkdir()
    path = tmp_path / "in" / "one.docx"
    path.write_bytes(docx.build(BODY, ["head ann@mail.example"], ["foot"], 'HYPERLINK "mailto:ann@mail.example"', "mailto:ann@mail.example"))
    return path


def test_units_of_a_package(package):
    got = [(part, unit, text) for part, unit, _, text in docx.package_units(package.read_bytes())]
    assert [t for _, _, t in got] == [*BODY, "link", "head ann@mail.example", "foot"]
    assert got[5][:2] == ("word/header1.xml", "word/header1.xml:p0000")


def test_spans_go_into_their_runs():
    import xml.etree.ElementTree as ET

    w = docx.MAIN
    p = ET.fromstring(f'<w:p xmlns:w="{w}"><w:r><w:t>Maya </w:t></w:r><w:r><w:t>Ver</w:t><w:tab/></w:r><w:r><w:t>lin x</w:t></w:r></w:p>')
    assert docx.text_nodes(p)[0] == "Maya Ver\tlin x"
    assert docx.write_span(p, 0, 12, "New Name") and [n.text for n, _, _ in docx.text_nodes(p)[1]] == ["New Name", "", " x"]
    assert not docx.write_span(ET.fromstring(f'<w:p xmlns:w="{w}"/>'), 0, 1, "x")


def test_command_line(spark, package, tmp_path, capsys):
    truth = tmp_path / "truth.json"
    truth.write_text(json.dumps({"source": "made up", "annotations": [{"type": "PERSON", "text": "Maya Verlin", "unit_id": "word/document.xml:p0001"}, {"type": "EMAIL", "text": "gone@x.example"}]}))
    out, report = tmp_path / "out", tmp_path / "report.md"
    code = cli.main(["--input", str(package.parent), "--output", str(out), "--predictions", str(tmp_path / "p"), "--ground-truth", str(truth), "--report", str(report)])
    result = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert code == 0 and result["passed"] and result["hyperlinks_checked"] == 1 and result["field_codes_checked"] == 1
    text = report.read_text()
    assert "| PERSON | 1 | 2 | 1 | 1 | 0 |" in text and "Verlin" not in text and text.count("\n## ") == 7
    made = docx.read_units(spark.read.parquet(str(out / "packages"))).collect()
    whole = "\n".join(r.text for r in made)
    assert "Verlin" not in whole and "VERLIN" not in whole and "ann@" not in whole and "Contact person" in whole
    items = [json.loads(x) for f in (tmp_path / "p").glob("part-*") for x in f.read_text().splitlines()]
    assert items[0]["prediction_count"] == len(items[0]["predictions"]) == 4 and items[0]["seed"] == 1337


def test_command_line_refuses(package):
    for args in (["--input", "a.txt", "--output", "b"], ["--input", "same", "--output", "same"]):
        with pytest.raises(SystemExit) as e:
            cli.main(args)
        assert e.value.code == 2
    if not pdf.available():
        with pytest.raises(RuntimeError):
            pdf.read_units(None)


def test_a_leak_is_reported_by_shape(spark):
    done = redact_units(X.documents(spark))
    left = residual_values(done.entities, X.documents(spark)).collect()
    assert left and all("Verlin" not in r.shape for r in left)
    assert not summary(done.entities, X.documents(spark)).first().passed


def test_json_items(spark, tmp_path):
    items = [{"type": "ORG", "text": "A B", "location": "x:p1"}, {"type": "IP", "text": "::1", "start": 3}]
    for name, content in (("list.json", items), ("object.json", {"source": "s", "annotations": items})):
        (tmp_path / name).write_text(json.dumps(content, indent=1))
        rows = jsonio.read_annotations(spark, str(tmp_path / name)).orderBy("id").collect()
        assert [(r.id, r.type, r.location, r.start) for r in rows] == [(0, "ORG", "x:p1", None), (1, "IP", None, 3)]


def test_chunk_lines(spark, tmp_path):
    (tmp_path / "gt_01.jsonl").write_text('﻿{"unit_id": "u", "type": "ORG", "text": "A"}\n\n{"unit_id": "v", "type": "IP", "text": "B"}\n', encoding="utf-8")
    assert {(r.file, r.unit_id) for r in jsonio.read_chunks(spark, str(tmp_path)).collect()} == {("gt_01.jsonl", "u"), ("gt_01.jsonl", "v")}
    (tmp_path / "gt_02.jsonl").write_text("{broken secret\n")
    with pytest.raises(Exception, match="invalid JSON in gt_02") as e:
        jsonio.read_chunks(spark, str(tmp_path)).collect()
    assert "secret" not in str(e.value).split("SQLSTATE")[0]


def test_chunks_of_units(spark, tmp_path):
    from umbra.operators.evaluate import chunked

    jsonio.write_chunks(chunked(X.documents(spark), most=60), str(tmp_path / "chunks"))
    back = spark.read.json(str(tmp_path / "chunks"))
    assert back.count() == X.documents(spark).count() and back.where("doc_id = 3").select("chunk").distinct().count() > 1


def test_digests(spark, package):
    import hashlib

    assert digests(docx.files(spark, str(package.parent))).first().sha256 == hashlib.sha256(package.read_bytes()).hexdigest()
    assert docx.read_members(docx.files(spark, str(package.parent))).count() == len(zipfile.ZipFile(package).namelist())


def test_report_without_instances(spark):
    none = X.truth(spark).limit(0)
    missed, wrong = unmatched(none, none)
    assert "N/A (no instances)" in render(by_type(none, none), missed, wrong) and "N/A" in render(by_type(none, none), missed, wrong, {"source": "x"})


def test_streams(spark, tmp_path):
    X.documents(spark).write.parquet(str(tmp_path / "units"))
    stream = spark.readStream.schema(UNIT).parquet(str(tmp_path / "units"))
    query = detect_stream(stream, contextual=False).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("found").where(F.size("spans") > 0).count() == 1
    got = []
    query = redact_stream(stream, lambda df, _: got.extend(df.collect()), str(tmp_path / "c2"))
    query.awaitTermination()
    assert len(got) == X.documents(spark).count() and not any("Verlin" in r.text for r in got)


def test_function_of_sql(spark):
    register(spark)
    rows = spark.sql("SELECT d.* FROM VALUES ('Mr. Ravi Kumar, Director') AS t(x), LATERAL detect_pii(t.x) AS d").collect()
    assert [(r.type, r.text) for r in rows] == [("PERSON", "Ravi Kumar")] * len(rows) and rows


def test_demo_package(spark):
    """The counts that are published for the described tool's own fixture of this shape."""
    units = docx.read_units(X.demo_package(spark))
    assert units.count() == 49 and X.demo_truth(spark).count() == 26
    done = redact_units(units)
    found = done.entities.withColumn("id", F.xxhash64("unit_id", "start")).drop("doc_id", "context")
    missed, wrong = unmatched(X.demo_truth(spark), found)
    assert missed.count() == wrong.count() == 0
    members = docx.read_members(docx.write_packages(X.demo_package(spark), done.replaced))
    row = summary(done.entities, done.units, members).first()
    assert row.passed and row.prediction_count == 26 and row.distinct_predicted_values == 13 and row.hyperlinks_checked == row.field_codes_checked == 1


def test_stale_links_are_counted(spark, package):
    """The members of the package as it was still hold the address in a link and in a field code."""
    packages = docx.files(spark, str(package.parent))
    done = redact_units(docx.read_units(packages))
    row = summary(done.entities, done.units, docx.read_members(packages)).first()
    assert (row.hyperlinks_checked, row.stale_hyperlinks, row.field_codes_checked, row.stale_field_codes) == (1, 1, 1, 1)
    assert row.residual_original_value_count > 0 and not row.passed


def test_pages_become_packages(spark):
    units = spark.createDataFrame([(f"page-{i:03d}", i - 1, t) for i, t in ((1, "one\ntwo"), (3, "three"))], "unit_id string, seq int, text string")
    files = spark.createDataFrame([("a/x.pdf",), ("a/none.pdf",)], "path string")
    units = units.withColumn("doc_id", F.xxhash64(F.lit("a/x.pdf")))
    made = {r.path: bytes(r.content) for r in docx.page_packages(files, units).collect()}
    assert [t for *_, t in docx.package_units(made["a/x.docx"])] == ["Source page 001", "one", "two", "Source page 003", "three"] and not list(docx.package_units(made["a/none.docx"]))


def test_command_line_with_a_model_and_examples(spark, package, tmp_path, capsys, monkeypatch):
    (tmp_path / "mine.py").write_text("def load():\n    return lambda text: [('ORG', 0, 4)] if text == 'foot' else []\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "mine.py"))
    truth = tmp_path / "truth.json"
    truth.write_text(json.dumps({"source": "in/one.docx", "annotations": [{"type": "PERSON", "text": "Maya Verlin", "unit_id": "word/document.xml:p0001"}, {"type": "EMAIL", "text": "gone@x.example"}]}))
    orgs = []
    for i, more in enumerate(([], ["--no-spacy"])):
        cli.main(["--input", str(package.parent), "--output", str(tmp_path / f"o{i}"), "--ground-truth", str(truth), "--include-examples", "--seed", "1338", "--model", "mine:load", *more])
        result = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        orgs.append(next(m["detected"] for m in result["metrics"] if m["type"] == "ORG"))
        assert [x["text"] for x in result["missed_examples"]] == ["gone@x.example"] and "MAYA VERLIN" in {x["text"] for x in result["wrong_examples"]}
    assert orgs == [1, 0]


def test_annotations_name_their_document(spark):
    truth = spark.createDataFrame([(0, None, "ORG", "x")], "id long, doc_id long, type string, text string")
    packages = spark.createDataFrame([("f/a.docx",), ("f/b.docx",)], "path string")
    named = cli.of_document(truth, "input/b.docx", packages).first().doc_id
    assert named == packages.where("path = 'f/b.docx'").select(F.xxhash64("path")).first()[0]
    with pytest.raises(ValueError):
        cli.of_document(truth, "other.docx", packages)


def test_redact_in_sql(spark):
    register(spark)
    assert spark.sql("SELECT redact('Mr. Ravi Kumar, Director') AS a, redact(NULL) AS b, redact('') AS c").first()[:] == ("Mr. [PERSON], Director", None, "")

"""Operators against small fixtures: expected values, nulls, repeated rows, extra columns."""

import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import text as tx
from corpusloom.operators import lab, legal, nested, rollups, units, vectors
from corpusloom.sources import files, sinks


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


RISK = [
    ("The landlord may forfeit 100% of the deposit within 24 hours.", "critical"), ("Pay 3 months rent as penalty with 7 days notice.", "high"), ("Rent is due within 7 days.", "medium"),
    ("Either party may give 60 days notice.", "low"), (None, "low"), ("", "low"),
]


@pytest.mark.parametrize("text,level", RISK)
def test_legal_risk(spark, text, level):
    r = one(spark, legal.legal_risk(F.coalesce(F.col("t"), F.lit(""))), t=text)
    assert r["level"] == level


def test_ladders(spark):
    rows = [(c, h, m) for c in range(4) for h in range(4) for m in range(4)]
    df = spark.createDataFrame(rows, "critical int, high int, medium int")
    counts = {k: F.col(k) for k in ("critical", "high", "medium")}
    for r in df.select("*", legal.document_risk(counts).alias("a"), legal.document_risk(counts, policy="strict").alias("b")).collect():
        c, h, m = r[:3]
        assert r["a"] == ("critical" if c else "high" if h >= 2 else "medium" if h or m >= 3 else "low" if m else "none")
        assert r["b"] == ("critical" if c or h >= 2 else "high" if h or m >= 3 else "medium" if m else "low")


def test_laws_prefer_the_year(spark):
    df = spark.createDataFrame([(1, "Under the Premises Act tenants pay. The Premises Act, 1972 applies. Article 12 too.", 5), (2, None, 5), (3, "", 5)], "k int, t string, law int")
    got = {(r["k"], r["law"], r["year"], r["article"]) for r in legal.law_references(df, "k", "t").collect()}
    assert (1, "Constitution of India", "", "12") in got
    assert any(y == "1972" for _, _, y, _ in got)


def test_law_search_is_bounded(spark):
    """A long text of nothing but words must not explode the search."""
    df = spark.createDataFrame([(1, "word " * 20000 + "Act")], "k int, t string")
    assert legal.law_references(df, "k", "t").count() <= 1


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab .,!?\n\t-1", max_size=60))
def test_whitespace_is_idempotent(spark, t):
    df = spark.createDataFrame([(t,)], "t string").select(tx.cleaned(F.col("t"), tx.WHITESPACE).alias("a"))
    r = df.select("a", tx.cleaned(F.col("a"), tx.WHITESPACE).alias("b")).first()
    assert r["a"] == r["b"] and "\n\n\n" not in r["a"]


def test_sections_keep_every_line_after_the_first_boundary(spark):
    t = "preface\nRENT\nTen per month.\n\nDEPOSIT\nTwo months.\nmore"
    got = legal.sections(spark.createDataFrame([(1, t, "x"), (2, None, "y")], "k int, t string, content string"), "k", "t").orderBy("section_no").collect()
    assert [(r["section_type"], r["start_line"], r["end_line"]) for r in got] == [("rent", 2, 4), ("deposit", 5, 7)]
    assert got[1]["content"] == "DEPOSIT\nTwo months.\nmore"


FLAGS = [(8.2, 12.0, 16.0, "Hemoglobin", "low"), (6.0, 12.0, 16.0, "Hemoglobin", "critical_low"), (3.8, 0.7, 1.3, "Serum Creatinine", "high"), (1.0, None, None, "x", "unknown"), (None, 1.0, 2.0, "x", "unknown"), (1.0, None, 2.0, "x", "normal")]


@pytest.mark.parametrize("v,lo,hi,test,flag", FLAGS)
def test_flags(spark, v, lo, hi, test, flag):
    df = spark.createDataFrame([(v, lo, hi, test)], "v double, lo double, hi double, t string")
    assert df.select(lab.calculated_flag(F.col("v"), F.col("lo"), F.col("hi"), F.col("t")).alias("x")).first()["x"] == flag


def test_lab_lines(spark):
    names = spark.createDataFrame([("hemoglobin", "Hemoglobin", 1), ("alp", "Alkaline Phosphatase", 2)], "alias string, standard string, ord int")
    t = "Patient Name: John Doe\nAge: 45 Years\nHemoglobin 10.2 g/dL 12.0 - 16.0 LOW\nALP 120 IU/L 44-147\n\nVitamin B12 300 pg/mL 200-900"
    got = {r["test_name"]: r for r in lab.parse_lines(spark.createDataFrame([(1, t)], "k int, t string"), "k", "t", names).collect()}
    assert got["Hemoglobin"]["value"] == 10.2 and got["Hemoglobin"]["flag"] == "low" and got["Hemoglobin"]["ref_high"] == 16.0
    assert got["ALP"]["test_name_standardized"] == "Alkaline Phosphatase" and got["ALP"]["ref_high"] == 147.0
    assert "Patient Name" not in got and "Age" not in got


def test_nested_forms_dont_vote(spark):
    """A path is a list wherever it is one anywhere, however many lone objects stand there."""
    plain, lone = json.dumps([{"notes": [{"a": 1}]}]), json.dumps([{"notes": {"a": 2}}])
    for texts in ([plain, lone, lone, lone], [plain, plain, lone]):
        df = spark.createDataFrame(list(enumerate(texts)), "k long, j string")
        n = nested.flatten(df, ["j"], "k").where("kind = 'object'").select("k", "node_path", "parent_path").collect()
        assert {(r["k"], r["node_path"], r["parent_path"]) for r in n} == {(k, p, q) for k in range(len(texts)) for p, q in (("j[0]", ""), ("j[0].notes[0]", "j[0]"))}


def test_nested_numbered_keys_keep_their_places(spark):
    df = spark.createDataFrame([(1, json.dumps({"0": {"a": 1}, "90": {"a": 2}}), 3), (2, None, 3), (3, "", 3), (4, "{broken", 3)], "k long, j string, kind int")
    n = nested.flatten(df, ["j"], "k")
    assert {r["node_path"] for r in n.where("kind = 'object'").collect()} == {"j[0]", "j[90]"}
    assert n.where("kind = 'rejected'").count() == 1


def test_units_of_zero_and_negative_numbers(spark):
    dim = spark.createDataFrame([("Serum Sodium", ["Na"], "mmol/L", 1.0, 22.99, 135.0, 145.0)], "test_name_standardized string, aliases array<string>, common_unit string, step double, molar_mass double, typical_low double, typical_high double")
    cols = "result_id long, test_name string, test_name_standardized string, value double, value_raw string, unit string, reference_range string, ref_low double, ref_high double, raw_text string"
    rows = [(i, "Na", "Serum Sodium", v, str(v), u, "", None, None, "") for i, (v, u) in enumerate([(140.0, "mmol/L"), (0.0, "mmol/L"), (141.0, None), (0.0, None)])]
    got = {r["result_id"]: r for r in units.convert_units(spark.createDataFrame(rows, cols), dim).collect()}
    assert got[0]["common_value"] == 140.0 and got[1]["common_value"] == 0.0 and not got[1]["uncertain"] and got[3]["uncertain"]


def test_centroids_and_best_prototype(spark):
    rows = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [-1.0, 0.0]), (4, None, None)], "id int, label string, v array<double>")
    c = vectors.centroids(rows, "label", "v")
    assert {r["label"]: list(r["centroid"]) for r in c.collect()} == {"a": [0.5, 0.5], "b": [-1.0, 0.0]}
    b = {r["id"]: r["label"] for r in vectors.best_prototype(rows.select("id", "v"), "id", "v", c, "label", "centroid").collect()}
    assert b == {1: "a", 2: "a", 3: "b"}


def test_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("zwei\nZeilen", "utf-8")
    (tmp_path / "a.txt").write_text("eins", "utf-8")
    assert [r["text"] for r in files.texts(spark, str(tmp_path)).orderBy("path").collect()] == ["eins", "zwei\nZeilen"]
    assert files.texts(spark, str(tmp_path), limit=1).first()["text"] == "eins"
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(buf.getvalue())
    (tmp_path / "d.docx").write_bytes(b"no document")
    assert [r["text"] for r in files.documents(spark, str(tmp_path)).orderBy("path").collect()] == ["One\nTwo", None]
    kinds = {r["path"][-6:]: r["kind"] for r in files.directory(spark, str(tmp_path)).collect()}
    assert kinds["c.docx"] == "docx" and kinds["/a.txt"] == "text"
    assert [r["text"] for r in files.extracted(spark, str(tmp_path), "a.txt", lambda c: c.decode().upper()).collect()] == ["EINS"]


def test_laboratory_table(spark):
    df = spark.createDataFrame([(1, ["Test Name", "Result", "Unit", "Reference Range"], [["Hb", "10.2", "g/dL", "12-16"], ["", "5", "", ""], ["TSH", None, "", ""]])], "k int, headers array<string>, rows array<array<string>>")
    assert [(r["test"], r["value"], r["unit"], r["reference"]) for r in files.laboratory_table(df, "k", "headers", "rows").collect()] == [("Hb", "10.2", "g/dL", "12-16")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("n1", "text one", ["a", "b"], [["1,2", None], ['say "x"', "y"]])], "name string, text string, h array<string>, r array<array<string>>")
    r = df.select(sinks.as_markdown(F.col("h"), F.col("r")).alias("m"), sinks.as_csv(F.col("h"), F.col("r")).alias("c"), sinks.as_plain(F.col("h"), F.col("r")).alias("p")).first()
    assert r["m"].split("\n")[2] == "| 1,2 |  |" and r["c"].split("\n")[1:] == ['"1,2",', '"say ""x""",y'] and r["p"].startswith("a | b")
    sinks.write_texts(df, "name", "text", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()["value"] == "text one"


def test_quota_and_offsets(spark):
    df = spark.createDataFrame([(1, i, i % 2 == 0, "x" * i) for i in range(6)] + [(2, 0, None, None)], "k int, i int, w boolean, t string")
    got = {(r["k"], r["i"]): r["taken"] for r in rollups.quota(df, "k", "i", F.col("w"), 2).collect()}
    assert [i for (k, i), t in got.items() if k == 1 and t] == [0, 2] and got[(2, 0)] is False
    assert {r["i"]: r["offset"] for r in rollups.offsets(df.where("k = 1"), "k", "i", F.length("t")).collect()}[3] == 3


def test_garbage_and_ascii(spark):
    assert one(spark, tx.without_garbage(F.col("t")), t="ok ###@@ fine 12###34") == "ok   fine 12 34"
    assert one(spark, tx.ascii_only(F.col("t")), t="Ünïcode ﬁ") == "Unicode fi"

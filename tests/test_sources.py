import json
import sqlite3
import zipfile

from pyspark.sql import functions as F

from tarnbeck.sources import readers, sinks


def test_separators(spark, tmp_path):
    for name, sep in (("a.csv", ","), ("b.csv", ";"), ("c.tsv", "\t"), ("d.txt", "|")):
        (tmp_path / name).write_text(f"x{sep}y\n1{sep}2\n3{sep}4\n")
        df = readers.read_any(spark, str(tmp_path / name))
        assert df.columns == ["x", "y"] and df.agg(F.sum("y")).first()[0] == 6


def test_json(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"a": 1}, {"a": 2}]))
    (tmp_path / "m.json").write_text(json.dumps({"k": {"a": 5}}))
    (tmp_path / "n.jsonl").write_text('{"a": 1}\nbroken\n{"a": 3}\n')
    total = lambda n: readers.read_any(spark, str(tmp_path / n)).agg(F.sum("a")).first()[0]
    assert (total("l.json"), total("m.json"), total("n.jsonl")) == (3, 5, 4)


def test_sqlite(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "t.db")
    con.executescript("create table b(x, y); insert into b values (1, 'p'), (2, null); create table a(z); insert into a values (9);")
    con.close()
    rows = readers.read_any(spark, str(tmp_path / "t.db")).orderBy("table", "row").collect()
    assert [(r.table, r.row, r["values"]) for r in rows] == [("a", 0, {"z": "9"}), ("b", 0, {"x": "1", "y": "p"}), ("b", 1, {"x": "2", "y": None})]


def test_xlsx(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "t.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>n</t></is></c></row><row r="2"><c r="A2"><v>7</v></c></row></sheetData></worksheet>')
    assert [(r.table, r["values"]) for r in readers.read_any(spark, str(tmp_path / "t.xlsx")).collect()] == [("S", {"name": "7"})]


def test_results_tree(spark, tmp_path):
    for path, body in (("t1/L1", {"agent_status": "exit 0", "reward": 1.0}), ("t1/L1/s2", {"agent_status": "exit 0", "sample": 5}), ("t2/L2", None)):
        (tmp_path / path).mkdir(parents=True)
        (tmp_path / path / "result.json").write_text("{bad" if body is None else json.dumps(body))
    rows = readers.read_results(spark, str(tmp_path), "agent_status string, reward double, sample int").collect()
    assert sorted((r.task_id, r.rung, r.sample, r.agent_status) for r in rows) == [("t1", "L1", 0, "exit 0"), ("t1", "L1", 5, "exit 0"), ("t2", "L2", 0, "unreadable result")]


def test_export(spark, tmp_path):
    df = spark.range(10).withColumn("part", F.when(F.col("id") < 2, "val").otherwise("train")).withColumn("source", F.lit("s"))
    assert sinks.export_split(df, str(tmp_path / "o"), index=("source",)) == {"rows": 10, "val": 2, "train": 8}
    assert spark.read.json(str(tmp_path / "o/rows")).count() == 10 and spark.read.json(str(tmp_path / "o/index")).count() == 10

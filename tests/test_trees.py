"""The tree scan and pushdown into SQLite and spreadsheets."""

import csv
import io
import random
import sqlite3

import pytest
from tarnbeck.sources import readers


def rows_of(df):
    return sorted(((r.path.rsplit("/", 1)[-1], None if r["values"] is None else sorted(r["values"].items()), r.error) for r in df.collect()), key=str)


def test_mixed_files(spark, tmp_path):
    (tmp_path / "deep/er").mkdir(parents=True)
    (tmp_path / "a.csv").write_bytes("name,n\nÅsa,1\n\n\"x, y\",2\n".encode())
    (tmp_path / "deep/b.csv").write_bytes("name;n\r\nÅsa;1\r\n\"p;q\";2".encode("latin-1"))
    (tmp_path / "deep/er/c.tsv").write_bytes(b"\xef\xbb\xbfname\tn\nz\t3\n")
    (tmp_path / "d.txt").write_bytes("name|n\nü|4\n".encode("utf-16"))
    (tmp_path / "e.csv").write_bytes(b"one\n1\n2\n")
    (tmp_path / "f.csv").write_bytes(b"a,a,,b\n1,2,3\n1,2,3,4,5\n\"open,1,2,3\n")
    (tmp_path / "g.csv").write_bytes(b"x,y\n" + b"1,2\n" * 20_000 + b"1,\xff\n")
    (tmp_path / "h.csv").write_bytes(b"")
    (tmp_path / "_hidden.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "z.parquet").write_bytes(b"no table of text")
    (tmp_path / "big.csv").write_bytes(b"a,b\n" + b"1,2\n" * 40_000)
    got = rows_of(readers.read_tree(spark, str(tmp_path), max_bytes=120_000).where("path not like '%/g.csv'"))
    want = [
        ("a.csv", {"name": "Åsa", "n": "1"}, None), ("a.csv", {"name": "x, y", "n": "2"}, None), ("b.csv", {"name": "Åsa", "n": "1"}, None), ("b.csv", {"name": "p;q", "n": "2"}, None),
        ("c.tsv", {"name": "z", "n": "3"}, None), ("d.txt", {"name": "ü", "n": "4"}, None), ("e.csv", {"one": "1"}, None), ("e.csv", {"one": "2"}, None),
        ("f.csv", {"a": "1", "a.1": "2", "_2": "3"}, "3 fields for 4 columns"), ("f.csv", {"a": "1", "a.1": "2", "_2": "3", "b": "4"}, "5 fields for 4 columns"), ("f.csv", {}, "unexpected end of data"),
        ("big.csv", None, "left out: 160004 bytes, 120000 at most"),
    ]
    assert got == sorted(((f, None if v is None else sorted(v.items()), e) for f, v, e in want), key=str)
    odd = readers.read_tree(spark, str(tmp_path / "g.csv")).where("error is not null").collect()
    assert [(r.at, dict(r["values"]), r.error) for r in odd] == [(4 + 80_000, {"x": "1", "y": "ÿ"}, "not utf-8")]


@pytest.mark.parametrize("split", [5, 23, 64, 1000])
def test_ranges_hold_every_line_once(spark, tmp_path, split):
    rng = random.Random(split)
    lines = [[f"k{i}", rng.choice(["", "x", "é" * rng.randrange(9), 'say "hi"', "a,b"])] for i in range(60)]
    out = io.StringIO()
    csv.writer(out, lineterminator=rng.choice(["\n", "\r\n"])).writerows([["a long name of the first column", "v"], *lines])
    data = out.getvalue().replace("k7,", "\nk7,").encode()
    (tmp_path / "t.csv").write_bytes(b"\n" + data)
    df = readers.read_tree(spark, str(tmp_path), split_bytes=split)
    assert df.rdd.getNumPartitions() == -(-(len(data) + 1) // split)
    got = [[r["values"]["a long name of the first column"], r["values"]["v"]] for r in df.orderBy("at").collect()]
    assert got == lines and df.where("error is not null").count() == 0


def test_line_ends_within_quotes(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"one\ntwo",1\nx,2\n')
    assert [dict(r["values"]) for r in readers.read_tree(spark, str(tmp_path), multiline="true").orderBy("at").collect()] == [{"a": "one\ntwo", "b": "1"}, {"a": "x", "b": "2"}]
    assert readers.read_tree(spark, str(tmp_path / "none")).collect() == []


@pytest.fixture()
def base(tmp_path):
    con = sqlite3.connect(tmp_path / "t.db")
    con.executescript("create table nums(id integer primary key, v real, name text, any); create table other(x); create table bare(k text primary key, n int) without rowid;")
    con.executemany("insert into nums values (?, ?, ?, ?)", [(i, i / 4, f"n{i % 10}", i) for i in range(1, 1001)])
    con.executescript("insert into nums values (2000, 'no number', null, x'00'); insert into other values (1), ('two'); insert into bare values ('p', 1), ('q', 2);")
    con.commit()
    con.close()
    return str(tmp_path / "t.db")


def test_pushdown_into_sqlite(spark, base):
    df = readers.read_sqlite(spark, base, "nums", rows=250)
    assert dict(df.dtypes) == {"id": "bigint", "v": "double", "name": "string", "any": "string"}
    assert df.rdd.getNumPartitions() == 8 and df.count() == 1001
    tests = [("id", ">", 100), ("id", "<=", 900), ("name", "in", ["n3", "n4"]), ("v", "is not null", None), ("any", "=", "303")]
    some = readers.read_sqlite(spark, base, "nums", where=tests, rows=250)
    assert [tuple(r) for r in some.collect()] == [(303, 75.75, "n3", "303")]
    assert some.count() == 1 and df.count() == 1001 and readers.read_sqlite(spark, base, "nums", where=[("v", ">", 249.0)]).count() == 4
    assert df.where("id = 2000").select("v", "name", "any").first() == (None, None, None)
    # what reaches the query: the reader itself says so
    import json

    from tarnbeck.sources.tables import SqliteSource

    source = SqliteSource({"path": base, "table": "nums", "rows": "250", "where": json.dumps(tests)})
    reader = source.reader(source.schema())
    assert [w for w, _ in reader.where] == ['"id" > ?', '"id" <= ?', '"name" in (?, ?)', '"v" is not null']
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 160
    assert readers.read_sqlite(spark, base, "nums", "name string", rows=250).columns == ["name"]
    assert readers.read_sqlite(spark, base, "nums", "name string", [("name", "=", "n1")]).count() == 100
    assert sorted(map(tuple, readers.read_sqlite(spark, base, "bare").collect())) == [("p", 1), ("q", 2)]


def test_only_the_tables_asked_for(spark, base):
    every = readers.read_any(spark, base)
    assert every.groupBy("table").count().count() == 3
    one = readers.read_any(spark, base, ["other"])
    assert [(r.row, r["values"]) for r in one.orderBy("row").collect()] == [(0, {"x": "1"}), (1, {"x": "two"})]
    assert one.rdd.getNumPartitions() == 1 and every.rdd.getNumPartitions() == 3
    # filters of one query do not stay for another
    assert every.where("table = 'other'").count() == 2 and every.count() == 1005 and every.where("table = 'none'").count() == 0
    assert readers.read_any(spark, base, ["none"]).count() == 0

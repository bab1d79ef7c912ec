import json

from subsumer import DiscoveryConfig, discover
from subsumer.config import Dialect
from subsumer.plans.report import nested, write
from subsumer.sources import PRESETS, from_folder, read_delimited, read_preset


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ragged_rows_nulls_and_line_breaks(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,b,c\n1,,"x"\n2,"",y\n3,z\n4,q,r,s\n5, lead,"l1\nl2"\n')
    assert rows(read_delimited(spark, str(path))) == [("1", None, "x"), ("2", None, "y"), ("5", "lead", "l1\nl2")]
    assert read_delimited(spark, str(path)).select("a").count() == 3
    assert read_delimited(spark, str(path), Dialect(skip_ragged=False)).count() == 5


def test_headers_separators_and_folders(spark, tmp_path):
    (tmp_path / "x.tbl").write_text("1|a\n2|\\N\n")
    df = read_delimited(spark, str(tmp_path / "x.tbl"), Dialect(separator="|", header=False, null_string="\\N", escape="\0"))
    assert df.columns == ["column0", "column1"]
    assert rows(df) == [("1", "a"), ("2", None)]
    (tmp_path / "y.tbl").write_text("")
    found = from_folder(spark, str(tmp_path), Dialect(separator="|", header=False))
    assert list(found) == ["x", "y"]
    assert found["y"].columns == []


def test_presets(spark, tmp_path):
    assert len(PRESETS) == 12
    (tmp_path / "one.csv").write_text("k,v\n1,2\n")
    (tmp_path / "other.txt").write_text("no")
    assert list(read_preset(spark, "EU", str(tmp_path))) == ["one"]


def test_tables_by_name(spark, tmp_path):
    for name in ("vw", "audi", "stray"):
        (tmp_path / f"{name}.csv").write_text("k\n1\n")
    assert list(read_preset(spark, "CARS", str(tmp_path), ["vw"])) == ["vw"]
    assert list(from_folder(spark, str(tmp_path), tables=["vw", "audi"])) == ["vw", "audi"]
    assert [len(PRESETS[k].tables) for k in ("ANIMAL_CROSSING", "CARS", "DATA_GOV", "POPULATION", "WEB_TABLES")] == [30, 13, 16, 1, 5000]


def test_reports(spark, tmp_path):
    tables = {"s": spark.createDataFrame([("1", "a")], "`x, y` string, z string"), "t": spark.createDataFrame([("1", "a")], "p string, q string")}
    found = discover(tables, DiscoveryConfig())
    first = {r.relation: r.dependants for r in nested(found).filter("layer = 2").collect()}
    assert first["s"][0].dependant == ["x, y", "z"]
    assert first["s"][0].referenced[0].attribute == ["p", "q"]
    write(found, str(tmp_path / "out"))
    lines = [json.loads(x) for p in (tmp_path / "out" / "run").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted((x["layer"], x["valid"]) for x in lines) == [(1, 4), (2, 2)]
    assert {(x["total_attributes"], x["total_unary"], x["total_nary"]) for x in lines} == {(4, 4, 2)}


def test_command_line(spark, tmp_path, capsys):
    from subsumer.__main__ import main

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("x\n1\n2\n")
    (folder / "b.csv").write_text("y\n1\n2\n3\n")
    main([str(folder), "--threshold", "1.0"])
    assert "a.x" in capsys.readouterr().out
    main([str(folder), "--out", str(tmp_path / "out")])
    assert list((tmp_path / "out" / "pinds").glob("layer=1/*.json"))

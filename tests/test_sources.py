import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import options
from gridloom.operators import prepare
from gridloom.sources import readers, writers
from gridloom.streaming import apply as streams

TABLE = "x1,x2,y\n0.5,1.5,0\n1.5,2.5,1\n"


@pytest.mark.parametrize("head,want", [("", []), ("--target,y,\n--,,\n,,\n", ["--target", "y", "--"]), ("--target y\n\n\n", ["--target", "y"])])
def test_csv_with_options(spark, tmp_path, head, want):
    f = tmp_path / "t.csv"
    f.write_text(head + TABLE)
    df, args = readers.read_csv(spark, str(f))
    assert args == want and df.columns == ["x1", "x2", "y"] and dict(df.dtypes) == {"x1": "double", "x2": "double", "y": "int"}
    assert sorted(r.y for r in df.collect()) == [0, 1]


def test_rows_like_the_header_stay(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_text("--target y\n\nx,y\na,b\nx,y\n--target y,\n-1,2\n")
    df, args = readers.read_csv(spark, str(f))
    assert args == ["--target", "y"] and sorted((r.x, r.y) for r in df.collect()) == [("--target y", None), ("-1", "2"), ("a", "b"), ("x", "y")]


def test_json_kinds(spark, tmp_path):
    rows = [{"a": 1}, {"a": 2}]
    (tmp_path / "l.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text("\n".join(map(json.dumps, rows)))
    for n in ("l.jsonl", "a.json", "b.json"):
        assert sorted(r.a for r in readers.read_table(spark, str(tmp_path / n)).collect()) == [1, 2]
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.unknown")


def test_npy(spark, tmp_path):
    np.save(tmp_path / "m.npy", np.arange(6.0).reshape(3, 2))
    assert readers.read_table(spark, str(tmp_path / "m.npy")).columns == ["c0", "c1"]
    np.save(tmp_path / "v.npy", np.arange(6.0))
    with pytest.raises(ValueError):
        readers.read_npy(spark, str(tmp_path / "v.npy"))


def workbook(path, rows, sheets=1):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def cell(r, c, v):
        ref = f"{chr(65 + c)}{r + 1}"
        return f'<c r="{ref}"><v>{v}</v></c>' if isinstance(v, (int, float)) else f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'

    body = "".join(f"<row>{''.join(cell(i, j, v) for j, v in enumerate(r) if v is not None)}</row>" for i, r in enumerate(rows))
    with zipfile.ZipFile(path, "w") as z:
        for k in range(sheets):
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def test_workbook(spark, tmp_path):
    f = tmp_path / "w.xlsx"
    workbook(f, [["--target y", None], ["--categoricals", "s,x0"], [None], ["s", "x0", "y", None], ["a", 1.5, 0], ["b", None, 1]])
    df, args = readers.read_workbook(spark, str(f))
    assert args == ["--target", "y", "--categoricals", "s,x0"] and dict(df.dtypes) == {"s": "string", "x0": "double", "y": "bigint"}
    assert [tuple(r) for r in df.collect()] == [("a", 1.5, 0), ("b", None, 1)]
    workbook(f, [["a"], [1]], 2)
    with pytest.raises(ValueError):
        readers.read_workbook(spark, str(f))


def test_train_tests(spark, tmp_path):
    for n in ("train", "t1", "t2"):
        (tmp_path / f"{n}.csv").write_text(TABLE)
    df = readers.read_train_tests(spark, str(tmp_path / "train.csv"), [str(tmp_path / f"{n}.csv") for n in ("t1", "t2")])
    assert {r._src: r["count"] for r in df.groupBy("_src").count().collect()} == {0: 2, 1: 2, 2: 2}
    (tmp_path / "t1.csv").write_text("x1,z\n1,2\n")
    with pytest.raises(ValueError):
        readers.read_train_tests(spark, str(tmp_path / "train.csv"), [str(tmp_path / "t1.csv")])


def test_options_merge():
    o = options.parse(["--target", "z", "--aer-bins", "7"], ["--target", "y", "--grouper", "g", "--"])
    assert (o.target, o.grouper, o.aer_bins, o.aer_smooth) == ("z", "g", 7, True)
    assert options.parse(["--no-aer-smooth", "--targets", "a,b"]).all_targets() == ["a", "b"]
    assert options.Options.from_dict(o.to_dict()) == o
    with pytest.raises(SystemExit):
        options.parse(["--unknown", "1"])


def test_run_folder_and_tables(spark, tmp_path):
    o = options.Options().to_dict()
    at = writers.run_folder(str(tmp_path), o)
    assert at == writers.run_folder(str(tmp_path), dict(reversed(o.items()))) and json.loads(open(f"{at}/options.json").read())["target"] == "target"
    df = spark.createDataFrame([(1, 0.5), (2, None)], "a int, b double")
    for kind in ("parquet", "csv", "json"):
        writers.write_table(df, f"{at}/t.{kind}", kind)
        assert spark.read.format(kind).option("header", "true").load(f"{at}/t.{kind}").count() == 2
    assert writers.fold_name("x", "csv", 3) == "test03/x_03.csv"
    assert "| 1 | 0.500 |" in writers.to_markdown(df)
    assert writers.not_available(df, "why").first().reason == "why"


def test_streams(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 7).cast("double").alias("x"), F.timestamp_seconds(F.col("id") * 3600 + 86400).alias("ts"), (F.col("id") % 2).cast("string").alias("k"))
    df = df.withColumn("x", F.when(F.col("id") % 10 != 0, F.col("x")))
    df.unionByName(df).repartition(3).write.parquet(str(tmp_path / "in"))
    imputer = prepare.fit_imputer(df, ["x"])
    stream = streams.read_stream(spark, str(tmp_path / "in"), df.schema)
    once = streams.first_deliveries(stream, "id", "ts")
    q = streams.write_stream(streams.apply_fitted(once, imputer), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 100 and out.where("x IS NULL").count() == 0 and out.agg(F.sum("x_NAN")).first()[0] == 10
    q = streams.write_stream(streams.windowed_profile(stream, "ts", ["k"], "x"), str(tmp_path / "w"), str(tmp_path / "cw"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "w")).agg(F.sum("n")).first()[0] >= 96

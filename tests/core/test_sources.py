import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tributary.functions import lineage
from tributary.operators import maxima
from tributary.sources import tables, workbooks


def test_files_of_many_kinds(spark, tmp_path):
    """Other delimiters, names, orders of columns; bad values; files that can't be used."""
    files = {
        "A one_streamflow.csv": "station, year,n_obs,max_discharge_cumec,max_discharge_date\n,2001,300,5.5,x\n,2002,10,-1,y\n,2003,12,bad,z\n",
        "B_streamflow.csv": "station, year,n_obs,max_discharge_cumec,max_discharge_date\nBee,2001,300,0,x\n",
        "C.csv": "max_discharge_cumec,max_discharge_date,year,station\n7.5,x,2002,Cee\n",
        "sub/D.csv": "Year;Max Flow;Station\n2003;8,5;Dee\n2004;9.5;Dee\n",
        "E.csv": "year,station\n2001,Eee\n",
        "F.csv": "station,max_q\nEff,3\n",
        "G.csv": "",
        "note.txt": "year,max_q\n1,1\n",
    }
    (tmp_path / "sub").mkdir()
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    good, rejects = tables.streamflow(spark, str(tmp_path))
    assert sorted((r.station, r.year, r.value) for r in good.collect()) == [("A one", 2001, 5.5), ("Cee", 2002, 7.5), ("Dee", 2004, 9.5)]
    why = {r.path.rsplit("/", 1)[1]: r.reason for r in rejects.collect()}
    assert why == {"B_streamflow.csv": "no positive maxima", "E.csv": "no column of maxima", "F.csv": "no column of years", "G.csv": "no line"}
    assert sorted(r.path.rsplit("/", 1)[1] for r in tables.list_files(spark, str(tmp_path)).collect()) == sorted(f.rsplit("/", 1)[-1] for f in files if f.endswith("csv"))
    assert tables.sniffed("a;b ;a") == (";", ["a", "b", "a_2"])


def test_lines_of_a_file_in_many_splits(spark, tmp_path):
    """Lines are numbered in their file's order, however it is cut; files of other lengths beside it."""
    for name, n in (("a", 4000), ("b", 3), ("c", 1500)):
        (tmp_path / f"{name}.csv").write_text("station,status,line\n" + "".join(f"{name}{i},{'SUCCESS' if i % 3 else 'FAILED'},{i + 2}\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows, _ = tables.morphometry(spark, str(tmp_path))
        got = rows.select("station", "excel_row", "line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == sum(1 for n in (4000, 3, 1500) for i in range(n) if i % 3)
    assert all(r.excel_row == int(r.line) for r in got) and "_split" not in rows.columns


def test_morphometry_and_climate(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "m.csv").write_text("station;status;area;rain_max\nA one; success ;1;0\nB;FAILED;2;0\nC;SUCCESS;3;0\n")
    rows, rejects = tables.morphometry(spark, str(tmp_path / "m"))
    assert sorted((r.station, r.excel_row, r.key) for r in rows.collect()) == [("A one", 2, "aone"), ("C", 4, "c")] and rejects.count() == 0
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "A-One_rain.csv").write_text("Rain Max\tmin_rain\n5\t1\n7\t\n")
    (tmp_path / "c" / "a one 2.csv").write_text("min_rain,station\n-3,A ONE\n")
    (tmp_path / "c" / "x.csv").write_text("other\n1\n")
    climate, rejects = tables.climate(spark, str(tmp_path / "c"), ["rain_max"], ["min_rain"], ("_rain",))
    assert [tuple(r) for r in climate.collect()] == [("aone", 7.0, -3.0)] and [r.reason for r in rejects.collect()] == ["no column of values"]
    joined = {r.key: r.rain_max for r in tables.with_climate(rows, (climate, "rain")).collect()}
    assert joined == {"aone": 7.0, "c": None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "k int, x array<string>")
    tables.write_table(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    tables.write_table(df, str(tmp_path / "c"), "csv")
    assert sorted(r.x or "" for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()) == ["", "a;b"]
    with pytest.raises(Exception, match="already exists"):
        tables.write_table(df, str(tmp_path / "p"))
    tables.write_report(tables.report_lines("Title", df.select("k"), [F.desc("k")]), str(tmp_path / "r"))
    assert [r.value for r in spark.read.text(str(tmp_path / "r")).collect()] == ["Title", "-----", "k 2", "k 1"]


def workbook(rows) -> bytes:
    cells = "".join(
        f'<row r="{r}">' + "".join(f'<c r="{c}{r}"' + (f' t="s"><v>{v}</v></c>' if isinstance(v, int) else f"><v>{v}</v></c>" if v[0].isdigit() else f' t="inlineStr"><is><t>{v}</t></is></c>') for c, v in row.items()) + "</row>" for r, row in rows.items()
    )
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="one" sheetId="1" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/data.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>Station X</t></si><si><r><t>two </t></r><r><t>parts</t></r></si></sst>")
        z.writestr("xl/worksheets/data.xml", f"<worksheet {space}><sheetData>{cells}</sheetData></worksheet>")
    return out.getvalue()


def test_workbooks(spark, tmp_path):
    """Cells by address, and a series at any step to annual maxima."""
    rows = {2: {"A": "name", "B": 0}, 5: {"B": "12.5", "AA": 1}, 8: {"A": "2001-05-01T00:00:00", "C": "3.5"}, 9: {"A": "2001-06-01T00:00:00", "C": "4.5"}, 10: {"A": "no time", "C": "99"}}
    rows[8]["A"] = "t2001"  # text
    book = {**rows, 8: {"A": "T2001-05-01T00:00:00", "C": "3.5"}, 9: {"A": "T2001-06-01T00:00:00", "C": "4.5"}}
    (tmp_path / "a.xlsx").write_bytes(workbook(book))
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    cells, rejects = workbooks.read_workbooks(spark, str(tmp_path))
    assert [r.reason for r in rejects.collect()] == ["no workbook: BadZipFile"]
    meta = workbooks.addressed(cells, station=(1, 1), area=(4, 1), note=(4, 26), gone=(70, 0)).first()
    assert (meta.station, meta.area, meta.note, meta.gone) == ("Station X", "12.5", "two parts", None)
    series = workbooks.series(cells, 7, time=0, value=2).withColumn("time", F.regexp_replace("time", "^T", ""))
    assert [(r.block, r.ams) for r in maxima.annual_maxima(series, "path", "time", "value").collect()] == [(2001, 4.5)]


def test_scratch_of_threads(spark):
    """A scratch that ends deletes its own tables only, while another is at work."""
    import threading

    meet, found = threading.Barrier(2), {}

    def work(name):
        with lineage.scratch(spark) as outliving:
            lineage.stored(spark.range(5), name)
            with lineage.scratch(spark) as inner:
                b = inner(spark.range(3), name)
            assert b.count() == 3
            meet.wait()
            found["kept"] = outliving(spark.range(7), name)
        meet.wait()

    def second():
        with lineage.scratch(spark):
            a = lineage.stored(spark.range(5), "second")
            meet.wait()  # the first has tables
            meet.wait()  # the first has ended
            found["second"] = a.count()

    n = lineage.left()
    threads = [threading.Thread(target=work, args=("first",)), threading.Thread(target=second)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert found["second"] == 5 and found["kept"].count() == 7 and lineage.left() == n + 1
    lineage.clear(spark, n)


def test_shared_folder(spark, monkeypatch):
    n = lineage.left()
    with lineage.scratch(spark) as outliving:
        lineage.stored(spark.range(3), "a")
        kept = outliving(spark.range(4), "b")
        assert lineage.left() == n + 2
    assert lineage.left() == n + 1 and kept.count() == 4
    lineage.clear(spark, n)
    assert lineage.left() == n
    with pytest.raises(Exception):
        kept.count()

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_dir(Cluster)


def test_written_workbook(spark, tmp_path):
    rows = [["a & b", 1, None, 2.5], [], [f"c{i}" for i in range(60)], [True]]
    got = workbooks.first_sheet(workbooks.workbook(rows))
    assert got == [["a & b", "1", None, "2.5"], [], [f"c{i}" for i in range(60)], ["True"]]

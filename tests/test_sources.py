import gzip
import json
import re

import pytest
from pyspark.sql.types import StructType

from conftest import rows
from sparkelt.errors import UnsafeQueryError
from sparkelt.functions.validation import check_read_query
from sparkelt.sources.files import (
    _arrow_opens, endpoint_options, format_of, ingest_landing, read_dataset, sniff_formats, write_dataset,
    write_through)
from sparkelt.sources.jdbc import connection_options, jdbc_url, read_jdbc_query, split_options
from sparkelt.sources.memory import read_memory, write_memory
from sparkelt.sources.paths import object_store_path, scoped_key, scoped_path, shared_dir, table_name
from sparkelt.sources.presets import PRESETS, preset


def test_scoped_paths():
    assert scoped_path("/base/", "t1", "/raw/x.csv", "p") == "/base/t1/p/raw/x.csv"
    assert scoped_key(" t1 ", "x.csv") == "t1/x.csv"
    assert object_store_path("blue-store", "acme", "bills.parquet", "y2020", "/deep/er/") == (
        "s3a://blue-store/deep/er/acme/y2020/bills.parquet")
    for tenant, key, project in (("", "x", None), (None, "x", None), ("t", " ", None), ("t", "../x", None), ("t", "a/./b", None),
                                 ("..", "x", None), ("t", "x", "../p"), ("a/b", "x", None), ("t", "x", "p/q")):
        with pytest.raises(ValueError):
            scoped_key(tenant, key, project)
    with pytest.raises(ValueError):
        object_store_path("", "t", "x")


def test_formats():
    assert [format_of(p) for p in ("a/b.csv", "b.pq", "b.parquet", "b.json/", "b.txt", "dir.v1/b", "b")] == [
        "csv", "parquet", "parquet", "json", None, None, None]


@pytest.mark.parametrize("name", ["t.csv", "t.json", "t.parquet", "t.pq", "t"])
def test_round_trips(spark, tmp_path, name):
    df = spark.createDataFrame([("apple", 10, 1.5), ("banana", 5, 2.0), ("or,\"ange", 8, 3.0)], "item string, qty long, price double")
    path = str(tmp_path / name)
    assert rows(write_through(df, path)) == rows(df)
    inferred = read_dataset(spark, path)
    assert rows(inferred.selectExpr("item", "CAST(qty AS LONG)", "price")) == rows(df)
    write_dataset(df.limit(1), path)
    assert read_dataset(spark, path).count() == 1


AWKWARD = [(1, "  pad "), (2, 'say "hi", \\'), (3, ""), (4, None), (5, "tab\tend"), (6, '"'), (7, "\\")]


def test_csv_keeps_every_text(spark, tmp_path):
    df = spark.createDataFrame(AWKWARD, "id long, text string")
    assert rows(write_through(df, str(tmp_path / "a.csv"))) == rows(df)
    broken = spark.createDataFrame([*AWKWARD, (8, "a\nb"), (9, " a\r\nb\r")], "id long, text string")
    with pytest.raises(Exception, match="line break"):
        write_dataset(broken, str(tmp_path / "b.csv"))
    assert rows(write_through(broken, str(tmp_path / "c.csv"), multiline=True)) == rows(broken)


@pytest.mark.parametrize("name", ["t.csv", "t.json"])
def test_times_keep_their_microseconds(spark, tmp_path, name):
    df = spark.sql("SELECT TIMESTAMP '2020-02-03 04:05:06.000007' AS t, TIMESTAMP_NTZ '2020-02-03 04:05:06.123456' AS n")
    assert rows(write_through(df, str(tmp_path / name))) == rows(df)


def test_endpoint_options(spark, tmp_path):
    options = endpoint_options("http://minio:9000")
    assert options == {"fs.s3a.endpoint": "http://minio:9000", "fs.s3a.path.style.access": "true"}
    path = str(tmp_path / "x.parquet")
    write_dataset(spark.range(3), path, options=options)
    assert read_dataset(spark, path, options=options).count() == 3


def test_json_document(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"a": 1}, {"a": 2}], indent=1))
    assert read_dataset(spark, str(tmp_path / "d.json"), multiline=True).count() == 2


def test_memory_tables_are_apart(spark):
    write_memory(spark.range(1), "tenant-a", "in/x.csv")
    write_memory(spark.range(2), "tenant-a", "in/x.csv", "p")
    assert read_memory(spark, "tenant-a", "/in/x.csv").count() == 1
    assert read_memory(spark, "tenant-a", "in/x.csv", "p").count() == 2
    with pytest.raises(KeyError):
        read_memory(spark, "tenant-b", "in/x.csv")
    with pytest.raises(ValueError):
        read_memory(spark, "tenant-a", "../other.csv")


def test_landing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("item,qty\napple,10\npear,3\n")
    (tmp_path / "b.txt").write_text('\n  [{"item": "fig", "qty": 1},\n {"item": "kiwi", "qty": 2}]')
    (tmp_path / "c.json").write_text('{"item": "plum", "qty": 7}\n{"item": "lime", "qty": 8}\n')
    (tmp_path / "d.csv").write_text("item,qty\ngood,1\nbad,many\n")
    (tmp_path / "e.json").write_text('[{"item": "half"')
    (tmp_path / "f 100%.csv").write_text("item,qty\nnut,4\n")
    accepted, report = ingest_landing(spark, str(tmp_path), StructType.fromDDL("item string, qty long"))
    assert rows(accepted, "item", "qty", "format") == [
        ("apple", 10, "csv"), ("fig", 1, "json"), ("kiwi", 2, "json"), ("lime", 8, "json_lines"), ("nut", 4, "csv"), ("pear", 3, "csv"),
        ("plum", 7, "json_lines")]
    found = {r["source_file"].rsplit("/", 1)[1]: (r["status"], r["row_count"], r["columns"]) for r in report.collect()}
    assert found == {
        "a.csv": ("ingested", 2, ["item", "qty"]), "b.txt": ("ingested", 2, ["item", "qty"]), "c.json": ("ingested", 2, ["item", "qty"]),
        "f%20100%25.csv": ("ingested", 1, ["item", "qty"]), "d.csv": ("rejected", 0, ["item", "qty"]), "e.json": ("rejected", 0, ["item", "qty"])}


def test_landing_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,city\nbob,paris\n")
    (tmp_path / "b.csv").write_text('city,name\nrome,"an""n"\n')
    (tmp_path / "c.csv").write_text("town,name\noslo,eve\n")
    (tmp_path / "d.csv").write_text("")
    (tmp_path / "e.csv").write_text("name,city\n")
    (tmp_path / "f.csv").write_text('name,city\n"two\nlines",bonn\n')
    schema = StructType.fromDDL("name string, city string")
    accepted, report = ingest_landing(spark, str(tmp_path), schema, multiline=True)
    assert rows(accepted, "name", "city") == [('an"n', "rome"), ("bob", "paris"), ("two\nlines", "bonn")]
    found = {r["source_file"].rsplit("/", 1)[1]: (r["status"], r["row_count"]) for r in report.collect()}
    assert found == {"a.csv": ("ingested", 1), "b.csv": ("ingested", 1), "c.csv": ("rejected", 0), "d.csv": ("empty", 0),
                     "e.csv": ("ingested", 0), "f.csv": ("ingested", 1)}


def test_landing_without_a_schema(spark, tmp_path):
    (tmp_path / "a.csv").write_text("item,qty\npear,3\n")
    (tmp_path / "b.csv").write_text("qty,item\n2.5,fig\n")
    (tmp_path / "c.json").write_text('{"item": "nut", "kg": 7}\n')
    accepted, report = ingest_landing(spark, str(tmp_path))
    assert rows(accepted, "item", "qty", "kg") == [("fig", 2.5, None), ("nut", None, 7), ("pear", 3.0, None)]
    assert report.where("status = 'ingested'").count() == 3


def bytes_of_last_jobs(spark, first):
    """Bytes that the stages from number ``first`` on have read, and the number of the next one."""
    store = spark.sparkContext._jsc.sc().statusStore()
    none = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = store.stageList(None, False, False, none, None)
    found = [stages.apply(i) for i in range(stages.size())]
    return sum(s.inputBytes() for s in found if s.stageId() >= first), max([s.stageId() for s in found], default=-1) + 1


def test_heads_without_their_files(spark, tmp_path):
    """What is read to know a file's format does not grow with the file."""
    with open(tmp_path / "big.csv", "w") as out:
        out.write("item,qty\n")
        out.writelines(f"thing {i},{i}\n" for i in range(400_000))
    (tmp_path / "one line.json").write_text("\n  [" + ", ".join('{"item": "x"}' for _ in range(100_000)) + "]")
    (tmp_path / "lines.json").write_text('{"item": "y"}\n' * 50_000)
    (tmp_path / "late.csv").write_text(" \n" * 70_000 + "a,b\r\n1,2\r\n")
    (tmp_path / "wide.csv").write_text(",".join(f"column{i}" for i in range(20_000)))
    (tmp_path / "blank.csv").write_text("\n  \n")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "deep").mkdir()
    with gzip.open(tmp_path / "deep" / "ü%20 zip.csv.gz", "wt") as out:
        out.write("\nitem,qty\npear,1\n")
    landing = str(tmp_path)
    _, before = bytes_of_last_jobs(spark, 0)
    heads = rows(sniff_formats(spark, landing))
    read, _ = bytes_of_last_jobs(spark, before)
    assert read < 100_000
    assert heads == rows(sniff_formats(spark, landing, heads_only=False))
    assert heads == rows(sniff_formats(spark, "file://" + landing))
    found = {file.rsplit("/", 1)[1]: (kind, head and head[:9]) for file, kind, head in heads}
    assert found == {"big.csv": ("csv", "item,qty"), "one%20line.json": ("json", None), "lines.json": ("json_lines", None),
                     "late.csv": ("csv", "a,b"), "wide.csv": ("csv", "column0,c"), "ü%2520%20zip.csv.gz": ("csv", "item,qty")}


def test_a_head_of_a_file_larger_than_any_disk_read(spark, tmp_path):
    """64 GB of which only the first line is written: a scan would not end in the time of a test."""
    with open(tmp_path / "huge.csv", "wb") as out:
        out.write(b"item,qty\n")
        out.truncate(1 << 36)
    assert [(r["format"], r["head"]) for r in sniff_formats(spark, str(tmp_path)).collect()] == [("csv", "item,qty")]


def test_a_store_that_arrow_cannot_open_is_scanned(spark, tmp_path):
    assert not _arrow_opens("odd://bucket/landing") and not _arrow_opens(str(tmp_path / "absent"))
    assert _arrow_opens(str(tmp_path)) and _arrow_opens("file://" + str(tmp_path))


def test_jdbc_without_a_database(spark):
    assert jdbc_url("postgresql", "db", "h") == "jdbc:postgresql://h:5432/db"
    assert jdbc_url("mysql", "db", "h", 99) == "jdbc:mysql://h:99/db"
    assert jdbc_url("sqlite", "/f.db") == "jdbc:sqlite:/f.db"
    assert jdbc_url("any", "", custom="jdbc:x:y") == "jdbc:x:y"
    with pytest.raises(ValueError):
        jdbc_url("snowflake", "db")
    assert connection_options("u", user="me") == {"url": "u", "user": "me", "fetchsize": "10000"}
    assert split_options("id", 0, 100, 8)["numPartitions"] == "8"
    assert table_name("north", "bills") == "north__bills" and table_name("9to5", "x;y") == "_39to5__x_3by"
    apart = [("a", "b_c", None), ("a_b", "c", None), ("a-b", "c", None), ("a", "raw/c", None), ("a", "c", None), ("a", "c.csv", None),
             ("a", "c.json", None), ("a", "c", "raw"), ("a__b", "c", None), ("a", "b__c", None), ("ä", "c", None), ("a", "_c", None), ("a_", "c", None)]
    names = [table_name(*a) for a in apart]
    assert len(set(names)) == len(names) and all(re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", n) for n in names)
    for text in ("SELECT 1; DROP TABLE t", "SELECT * FROM t WHERE x = 'a' /* ; */; SELECT 2", "/* SELECT */ UPDATE t"):
        with pytest.raises(UnsafeQueryError):
            check_read_query(text)
    for text in ("SELECT 'a--b; drop' AS s -- drop", "WITH x AS (SELECT 'update') SELECT * FROM x;", 'SELECT "delete" FROM `drop`'):
        assert check_read_query(text) == text
    with pytest.raises(UnsafeQueryError):
        read_jdbc_query(spark, {}, "DELETE FROM t")


def python_preset(name, i):
    """First-principles values of a preset row."""
    return {
        "ecommerce": lambda: (5000 + i, 1000 + i % 30, round(15.0 + (i * 7.5) % 450.0, 2)),
        "iot": lambda: (f"sensor-{i % 10 + 1:03d}", round(20.0 + (i * 0.3) % 15.0, 2), 100 - i % 60),
        "ledger": lambda: (100000 + i, f"ACC-{100 + i % 25}", round(10.0 + (i * 19.5) % 2500.0, 2)),
        "healthcare": lambda: (f"PAT-{500 + i}", f"{100 + i % 900:03d}-{10 + i % 90:02d}-{1000 + i % 9000:04d}",
                               round(75.0 + (i * 12.3) % 800.0, 2)),
        "customers": lambda: (1000 + i, 18 + i % 55, round(29.0 + (i * 3.7) % 300.0, 2)),
    }[name]()


PICKED = {
    "ecommerce": ("order_id", "customer_id", "amount"), "iot": ("device_id", "temperature", "battery_pct"),
    "ledger": ("txn_id", "account_id", "amount"), "healthcare": ("patient_id", "ssn", "visit_cost"),
    "customers": ("customer_id", "age", "monthly_spend"),
}


@pytest.mark.parametrize("name", sorted(PRESETS))
def test_presets(spark, name):
    assert rows(preset(spark, name, 2000), *PICKED[name]) == sorted((python_preset(name, i) for i in range(2000)),
                                                                     key=lambda r: [(False, str(v)) for v in r])
    assert preset(spark, name).count() == 100


def test_unknown_preset(spark):
    with pytest.raises(ValueError):
        preset(spark, "weather")


def test_shared_dir_reads_the_session(spark):
    assert shared_dir(spark, "x") != shared_dir(spark, "x")

    class Cluster:
        def __init__(self, **settings):
            self.conf = self
            self.settings = settings

        def get(self, key, default=None):
            return self.settings.get(key, default)

    assert shared_dir(Cluster(**{"spark.checkpoint.dir": "hdfs://n/c/", "spark.master": "yarn"}), "x").startswith("hdfs://n/c/x-")
    with pytest.raises(RuntimeError):
        shared_dir(Cluster(**{"spark.master": "yarn"}), "x")

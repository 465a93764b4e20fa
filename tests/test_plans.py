"""Every query against its DuckDB counterpart, and rows of our own for the expressions."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lingsmith.functions import layouts, scripts
from lingsmith.functions import text as X
from lingsmith.plans import ORACLES, QUERIES
from lingsmith.sources import lists
from lingsmith.streaming import keys

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in "documents conversations events part".split():
        c.sql(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    names = sorted(df.columns)
    other = duck.sql(ORACLES[name])
    assert sorted(other.columns) == names
    mine = sorted(repr(tuple(r)) for r in df.select(*names).collect())
    assert mine == sorted(repr(r) for r in other.project(", ".join(names)).fetchall())


def test_expressions(spark):
    df = spark.createDataFrame([("Привет hi",), ("abc где",), ("123",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(scripts.dominant(F.col("x"))).collect()] == ["Cyrillic", "Latin", None, None, None]
    df = spark.createDataFrame([("hELLO",), ("HEllo",), ("PCs",), ("Ok",)], "w string")
    assert [r[0] for r in df.select(X.caps_slip(F.col("w"))).collect()] == ["caps", "double", None, None]
    assert layouts.round_trips("ru") and layouts.round_trips("uk")
    df = spark.createDataFrame([("ghbdtn",)], "w string")
    assert df.select(layouts.transcode(F.col("w"), "ru")).first()[0] == "привет"


def test_sources(spark, tmp_path):
    (tmp_path / "list.txt").write_text("one 3\ntwo\tx\nthree\nfour 0\nfive 7 8\n")
    assert sorted(map(tuple, lists.frequency_list(spark, str(tmp_path / "list.txt")).collect())) == [("five", 7), ("one", 3)]
    (tmp_path / "forms.jsonl").write_text('{"word": "a", "forms": [{"form": "b", "tags": ["plural"]}, {"form": "c", "tags": ["class"]}, {"form": "d"}]}\n')
    assert sorted(r.form for r in lists.word_forms(spark, str(tmp_path / "forms.jsonl")).collect()) == ["a", "b", "d"]


def test_session_stream(spark, tmp_path):
    events = spark.createDataFrame([(1, 0), (1, 30), (1, 200), (2, 5)], "user_id long, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = keys.session_stream(stream, "60 seconds", "10 seconds").writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.user_id, r.n) for r in spark.table("sessions").collect()) == [(1, 1), (1, 2), (2, 1)]


def test_candidate_order_of_odd_rows(spark, tmp_path):
    """Texts without letters, ids that repeat and ids that are missing, as SQL has them."""
    rows = [(0, None), (1, None), (2, ""), (4, ""), (5, "123"), (8, "!"), (9, "abc"), (12, "abc"), (16, "слово"), (17, "漢字"), (20, "漢字"), (40, "abc"), (40, "слово"), (41, "abc"), (41, "слово"), (44, "ab"), (44, None), (45, "ab"), (45, ""), (None, "abc"), (None, "слово"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["o15_candidate_order"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(con.sql(ORACLES["o15_candidate_order"]).fetchall(), key=str)

"""Boundary tables for the operators, and the registered queries against their SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from sonolith.functions import circular, naming
from sonolith.operators import segments
from sonolith.plans.queries import QUERIES, SQL
from sonolith.streaming.sessions import session_spans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.exists(DIR), reason="no tables")
@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, DIR).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    plain = lambda df: sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).map(lambda x: f"{x:.4f}" if isinstance(x, float) else str(x)).itertuples(index=False)))
    assert plain(got) == plain(want)


def mask(spark, true, n, recording="r"):
    return spark.createDataFrame([(recording, i, i in true) for i in range(n)], "recording string, frame long, is_music boolean")


def test_gap_is_strict(spark):
    for gap, songs in ((11, 1), (12, 2)):
        m = mask(spark, set(range(100)) - set(range(40, 40 + gap)), 100)
        assert segments.segments(m, 12, 20).count() == songs


def test_join_across(spark):
    files = spark.createDataFrame([("s", f"f{i}", i, 50.0) for i in range(4)], "session string, file string, file_idx long, duration double")
    spans = spark.createDataFrame([("f0", 10.0, 45.0), ("f1", 5.0, 40.0), ("f3", 0.0, 30.0)], "file string, start double, end double")
    out = segments.join_across(spans, files, 5.0, 0.0).orderBy("index").collect()
    assert [(r.start, r.end, r.duration, len(r.parts)) for r in out] == [(10.0, 90.0, 70.0, 2), (150.0, 180.0, 30.0, 1)]
    late = spans.withColumn("start", F.col("start") + F.when(F.col("file") == "f1", 0.1).otherwise(0))
    assert segments.join_across(late, files, 5.0, 0.0).count() == 3


def test_absorb(spark):
    rows = [("r", i, "applause" if i == 30 else "music") for i in range(60)]
    out = segments.regions(spark.createDataFrame(rows, "recording string, frame long, label string"), 5).collect()
    assert [(r.label, r.start, r.end) for r in out] == [("music", 0, 60)]


def test_one_mode(spark):
    f = spark.createDataFrame([("r", i, -20.0, -3.0) for i in range(10)], "recording string, frame long, level double, flat double")
    assert segments.music_mask(f, "level", "flat").filter("is_music").count() == 10


def test_circle(spark):
    c = spark.createDataFrame([("triad", [1.0, 0.0, 0.0, 0.0, 0.7, 0.0, 0.0, 0.9, 0.0, 0.0, 0.0, 0.0]), ("flat", [1.0] * 12)], "n string, c array<double>")
    chroma = [F.element_at("c", i + 1) for i in range(12)]
    angle, r = circular.fifths(chroma)
    out = {x.n: x for x in c.select("n", circular.fifths_note(angle).alias("note"), r.alias("r")).collect()}
    assert out["triad"].note in "CG" and out["triad"].r > 0.5 and out["flat"].r < 0.05
    keys = {x.n: x for x in circular.key_estimate(c, chroma, ["n"]).collect()}
    assert keys["triad"].key == "C major" and (keys["flat"].key, keys["flat"].conf) == ("C major", -2.0)


def test_names(spark):
    df = spark.createDataFrame([("a/20240229_101112.wav", "."), ("x/240230-101112.wav", "../b")], "p string, a string")
    out = df.select(naming.start_time(F.col("p")).alias("t"), naming.album_stem(F.col("a")).alias("s"), naming.minutes(F.lit(125.9)).alias("m"), naming.note(F.lit("C minor"), F.lit(0.0), F.lit(92.4), F.lit(0.05)).alias("n")).collect()
    assert str(out[0].t) == "2024-02-29 10:11:12" and out[1].t is None and [r.s for r in out] == ["collection", "_b"]
    assert out[0].m == "2:05" and out[0].n == "C minor · ~92 bpm"


def test_stream_equals_batch(spark, tmp_path):
    if not os.path.exists(DIR):
        pytest.skip("no tables")
    e = spark.read.parquet(f"{DIR}/events.parquet").select("event_type", "ts")
    e.write.parquet(str(tmp_path / "in"))
    s = session_spans(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), "event_type", "ts", "30 minutes", "1 day")
    run = s.writeStream.format("memory").queryName("spans").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    batch = session_spans(e, "event_type", "ts", "30 minutes", "1 day")
    assert sorted(map(str, spark.table("spans").collect())) == sorted(map(str, batch.collect()))

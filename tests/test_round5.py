"""Findings of round 4: whole tables, whole joins."""

import duckdb
import numpy as np
import __spark_entry__ as entry


def embeddings(spark, path, ids):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.standard_normal(64))], i % 3) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    return con


def test_pair_cosine_reads_the_whole_table(spark, tmp_path):
    con = embeddings(spark, tmp_path, [*range(47, 53), 100, 2**40 + 1])
    got = {(r.i, r.j): r.sim for r in entry.queries()["pair_cosine"](spark, str(tmp_path)).collect()}
    assert len(got) == 8 * 7
    assert got == {(i, j): sim for i, j, sim in con.execute(entry.oracle_sql()["pair_cosine"]).fetchall()}

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq


def test_anomaly_ids_beyond_four_digits(spark, tmp_path):
    """The operator's ids are whole; the query's are those of its SQL, which keeps four digits."""
    import duckdb

    import __spark_entry__ as entry
    from tidewater.operators import vectors

    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(10_030, 64)) * 0.1
    v[-20:] += 4 * rnd.normal(size=(20, 64))
    pq.write_table(pa.table({"vec_id": pa.array(range(len(v)), pa.int64()), "embedding": pa.array(v.astype(np.float32).tolist(), pa.list_(pa.float32())), "label": pa.array([0] * len(v), pa.int32())}), tmp_path / "embeddings.parquet")
    got = sorted((r.id, r.score, r.anomaly_id, r["rank"]) for r in entry.queries()["vec_candidates"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert got == sorted(c.sql(f"SELECT id, score, anomaly_id, rank FROM ({entry.oracle_sql()['vec_candidates']})").fetchall())
    whole = vectors.candidates(spark.range(10_030).selectExpr("id", "cast(id as double) score"), 3)
    assert [r.anomaly_id for r in whole.orderBy("rank").collect()] == ["anomaly-10030", "anomaly-10029", "anomaly-10028"]

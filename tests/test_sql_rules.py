"""The SQL states the rules of its query exactly: rows at a limit, and groups that need many rounds."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from spectraweave.plans import all_queries

QUERIES, SQL = all_queries()


def embeddings(folder, vectors, labels):
    rows = pa.table({"vec_id": pa.array(range(len(vectors)), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array(labels, pa.int64())})
    pq.write_table(rows, f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{folder}/embeddings.parquet')")
    return con


def beyond(radius):
    """First components of fibers that lie farther from (0, 0) than the radius, but by less than the sixth decimal shows."""
    turn = np.random.default_rng(5).uniform(0, 2 * np.pi, 400_000)
    e = np.stack([np.cos(turn) / np.cos(np.radians(2)), np.sin(turn)], 1).astype(np.float64) * radius / 360
    e = e.astype(np.float32)
    ra, dec = 150 + e[:, 0].astype(float) / 10, 2 + e[:, 1].astype(float) / 10
    h = np.sin(np.radians(dec - 2) / 2) ** 2 + np.cos(np.radians(2)) * np.cos(np.radians(dec)) * np.sin(np.radians(ra - 150) / 2) ** 2
    sep = np.degrees(2 * np.arcsin(np.sqrt(h))) * 3600
    return e[(sep > radius + 5e-8) & (sep < radius + 4e-7)][:20]


@pytest.mark.parametrize("name, radius", [("jn_within_radius", 20.0), ("jn_cone_search", 60.0), ("jn_repeat_pairs", 15.0)])
def test_pairs_at_the_radius(spark, tmp_path, name, radius):
    far = beyond(radius)
    assert len(far)
    vectors = [[0.0] * 64, *[[float(x), float(y), *[0.0] * 62] for x, y in far]]
    con = embeddings(tmp_path, vectors, [1] + [2] * len(far))
    got = sorted((r.vec_id_l, r.vec_id_r) for r in QUERIES[name](spark, str(tmp_path)).collect())
    assert not [p for p in got if 0 in p and p != (0, 0)]
    assert got == sorted(r[:2] for r in con.sql(f"select vec_id_l, vec_id_r from ({SQL[name]})").fetchall())


def test_clip_needs_many_rounds(spark, tmp_path):
    # x(n) is little more than three times x(n / 2): a round takes out the last of them only
    v = [(-1.0) ** k * k**1.65 for k in range(64)]
    con = embeddings(tmp_path, [v], [0])
    got = sorted((r.fiber, r.idx, r.clipped) for r in QUERIES["rob_sigma_clip_converged"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(f"select fiber, idx, clipped from ({SQL['rob_sigma_clip_converged']})").fetchall())


def test_mean_on_a_limit(spark, tmp_path):
    # the mean of these is the limit itself, however they are added
    discounts = [0.01, 0.09, 0.02, 0.08, 0.03, 0.07, 0.04, 0.06, 0.05, 0.1, 0.0] * 7
    orders = [discounts, discounts[::-1], sorted(discounts), sorted(discounts, reverse=True)]
    n = sum(map(len, orders))
    rows = pa.table({"l_suppkey": [k for k, o in enumerate(orders) for _ in o], "l_quantity": [1.0] * n, "l_discount": [d for o in orders for d in o]})
    pq.write_table(rows, f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet')")
    got = {r.l_suppkey: r.d for r in QUERIES["qa_report"](spark, str(tmp_path)).collect()}
    assert got == dict(con.sql(f"select l_suppkey, d from ({SQL['qa_report']})").fetchall()) == dict.fromkeys(range(4), "warn")

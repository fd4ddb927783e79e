"""Queries without oracle SQL read whole tables."""

import duckdb
import numpy as np
import pytest

from roadloom.plans import catalogue

SF = "/root/testdata/sf0.01"


def test_chain_holds_all_users(spark):
    """The sizes of the clusters sum to the number of users in every draw, hence in the mean."""
    users = duckdb.sql(f"select count(distinct user_id) from '{SF}/events.parquet'").fetchall()[0][0]
    got = [r for r in catalogue.QUERIES["gibbs_chain"](spark, SF).collect() if r.quantity == "size"]
    assert users > 60 and sum(r["mean"] for r in got) == pytest.approx(users)


def test_every_edge_is_matched_among_all_others(spark):
    sf = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"select vec_id, embedding[1:4]::double[] from '{sf}/embeddings.parquet' order by 1").fetchall()
    ids, e = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]) * 1000
    a, b = e[:, :2], e[:, :2] + e[:, 2:] / 4
    d, n2 = b - a, ((b - a) ** 2).sum(1)
    want = {}
    for k, i in enumerate(ids):
        dist, t = [], []
        for p in (a[k], (a[k] + b[k]) / 2, b[k]):
            u = np.where(n2 <= 1e-12, 0, np.clip(((p - a) * d).sum(1) / np.maximum(n2, 1e-300), 0, 1))
            dist.append(np.hypot(*(p - a - u[:, None] * d).T))
            t.append(u)
        length = np.sqrt(n2[k])
        penalty = np.abs(np.abs(t[2] - t[0]) * np.sqrt(n2) - length) / max(length, 1.0)
        score = np.maximum(dist[0], dist[2]) + 0.45 * dist[1] + 18 * np.minimum(penalty, 4)
        ok = (dist[0] <= 90) & (dist[2] <= 90) & (dist[1] <= 160) & (ids != i)
        if ok.any():
            want[int(i)] = float(score[ok].min())
    want = {k: round(v, 5) for k, v in want.items()}
    got = {r.edge: r.score for r in catalogue.QUERIES["match_edges"](spark, sf).collect()}
    assert got == pytest.approx(want) and any(i % 5 for i in got)

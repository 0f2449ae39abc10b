"""Nearest neighbours with buckets cut into several parts, ties of different vectors, and spaces where few cells are visited."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from skerry.llm import ann


def vectors(spark, n):
    rng = random.Random(8)
    return spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(n)], "vec_id long, embedding array<double>")


def rows(df, **limits):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in ann.nearest(df, every=4, **limits).collect())


def brute(data, every, k):
    out = []
    for q, v in data.items():
        if q % every == 0:
            score = lambda w: sum(a * b for a, b in zip(v, w))  # noqa: E731, B023
            near = sorted((-score(w), i) for i, w in data.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    return sorted(out)


def test_parts_do_not_change_the_result(spark):
    df = vectors(spark, 400).persist()
    one = rows(df)
    assert len(one) == 2000 and rows(df, shard=50, at_once=7) == one


def test_entries_below_a_bound_are_not_written():
    """Each bucket would else write k + 1 entries for each query that visits it, however far they are."""
    rng = np.random.default_rng(3)
    x, hashing = rng.standard_normal((500, 6)), ann.Hashing(6, 10.0)
    listed = lambda m: pa.array([list(r) for r in m], pa.list_(pa.float64()))
    vectors = pa.table({"rep": pa.array(range(500)), "v": listed(x), "ids": pa.array([[i] for i in range(500)])})
    bounds = [-np.inf, float(np.sort(x @ x[1])[-3]), np.inf]
    queries = pa.table({"vec_id": pa.array(range(3)), "v": listed(x[:3]), "cut": pa.array([-np.inf] * 3), "bound": pa.array(bounds)})
    out = ann._search(hashing, 0.5, 20, 6)((pa.scalar(0),), vectors, queries).to_pylist()
    found = [sorted(r["rep"] for r in out if r["query_id"] == i) for i in range(3)]
    assert len(found[0]) == 21 and found[1] == sorted(np.argsort(-(x @ x[1]))[:3].tolist()) and found[2] == []


def test_no_task_receives_all_queries(spark):
    t = ["t", "bucket"]
    stored = spark.createDataFrame([(i, 0, i % 2) for i in range(900)], "rep long, t int, bucket int")
    asked = spark.createDataFrame([(i, 0, 0) for i in range(90)] + [(90, 0, 2)], "vec_id long, t int, bucket int")
    a, b = ann.dealt(stored, asked, shard=100, at_once=20)
    groups = b.groupBy(*t, "salt", "block").count().collect()
    assert len(groups) == 25 and max(r["count"] for r in groups) < 40  # five parts of vectors, five of queries; bucket 2 has no vectors
    met = a.join(b, [*t, "salt", "block"]).groupBy("rep", "vec_id").count()
    assert met.count() == 450 * 90 and met.where("count > 1").count() == 0


def test_ties_of_different_vectors_go_to_the_smaller_id(spark):
    rng = random.Random(4)
    data = {i: [float(rng.choice((-1, 0, 1))) for _ in range(6)] for i in range(300)}  # many inner products are equal
    data = {i: v for i, v in data.items() if any(v)}
    got = rows(spark.createDataFrame(list(data.items()), "vec_id long, embedding array<double>"))
    want = brute(data, 4, 20)
    assert len(got) == len(want) and sum(x == y for x, y in zip(got, want)) >= 0.9 * len(want)
    of = {}
    for q, _, i, s in got:
        of.setdefault(q, []).append((-s, i))
    assert all(found == sorted(found) for found in of.values())


@pytest.mark.parametrize("kind", ["float", "double"])
def test_every_query_has_all_candidates(spark, kind):
    rng = random.Random(6)
    near = [(i, [1.0 + rng.random() / 1e3, 0.0, rng.random() / 1e3]) for i in range(0, 200)]
    far = [(i, [-1.0, rng.gauss(0, 1), 5.0]) for i in (400, 404)]
    got = rows(spark.createDataFrame(near + far + [(408, [1.0, 2.0]), (409, [3.0, 1.0])], f"vec_id long, embedding array<{kind}>"))
    count = {}
    for q, *_ in got:
        count[q] = count.get(q, 0) + 1
    assert count == {**{i: 20 for i in range(0, 200, 4)}, 400: 20, 404: 20, 408: 1}

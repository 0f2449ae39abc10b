"""Periodic runs against every period of every text, and transforms against their definition."""

from __future__ import annotations

import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from skerry.llm import common, periodic


def brute(x):
    """(start, length, period) of all runs: each period's maximal stretches, of which the least period counts."""
    found = {}
    for q in range(1, len(x) // 4 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, k, q) for (s, k), q in found.items()), key=lambda r: (r[0], r[2]))


def some_texts(rng, most):
    for _ in range(rng.randrange(1, 7)):
        n, k = rng.randrange(most), rng.choice([1, 2, 3, 30])
        x = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.7:
            a, p = rng.randrange(n), rng.randrange(1, 2 + n // 4)
            x = x[:a] + [x[a + i % p] for i in range(n - a) if a + i % p < n]
        yield x + x[: rng.randrange(9)] * rng.randrange(7)


@pytest.mark.parametrize("block", [periodic.MAX_BLOCK, 4])
def test_all_runs(block, monkeypatch):
    """Also with blocks so short that longer periods need several windows."""
    monkeypatch.setattr(periodic, "MAX_BLOCK", block)
    rng = random.Random(block)
    for _ in range(150):
        texts = list(some_texts(rng, 130))
        counts, codes = np.array(list(map(len, texts))), np.array([c for t in texts for c in t], np.int64)
        offsets = np.cumsum(counts) - counts
        want = [(s + o, k, q) for t, o in zip(texts, offsets.tolist()) for s, k, q in brute(t)]
        assert list(map(tuple, periodic.runs_of(codes, counts).tolist())) == want


@pytest.mark.parametrize("n", [2, 8, 64, 128, 512])
def test_transform(n):
    x = np.random.default_rng(n).integers(0, periodic.PRIME, (3, n)).astype(float)
    w = pow(periodic.GENERATOR, (periodic.PRIME - 1) // n, periodic.PRIME)
    power = [pow(w, k, periodic.PRIME) for k in range(n)]
    want = [[sum(int(row[i]) * power[i * k % n] for i in range(n)) % periodic.PRIME for k in range(n)] for row in x]
    got = periodic.transform(x)
    assert (got % periodic.PRIME).astype(int).tolist() == want
    assert (periodic.transform(got, -1) % periodic.PRIME == x * n % periodic.PRIME).all()


def test_long_periods():
    x = np.random.default_rng(0).integers(0, 50_000, 300_000)
    x[1000:] = x[1000 + np.arange(299_000) % 70_001]
    assert periodic.runs_of(x, np.array([300_000])).tolist() == [[1000, 299_000, 70_001]]


def rows():
    rng = random.Random(3)
    out = [(i, " ".join(f"w{c}" for c in x), "x", 1, 2) for i, x in enumerate(x for _ in range(25) for x in some_texts(rng, 120))]
    long_ = "a b c d " * (common.STEP_BYTES // 8 + 500)  # a text that is longer than a step
    return [*out, (900, long_, "y", 0, 0), (901, None, None, None, None), (902, "", "", 0, 0), (903, " \n\t\x0b", "", 0, 0), (None, "go " * 9, "z", 0, 0), (904, "É É É É É É x|y", "z", 0, 0), out[3], out[3]]


def test_operator(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id long, text string, runs string, __runs int, c1 int").repartition(3)
    out = periodic.periodic_runs(docs)
    assert out.columns == [*docs.columns, "__n_words", "___runs", "__collapsed"]
    got = sorted(((r[0], r[1], r[5], [tuple(x) for x in r[6]], bytes(r[7]).decode()) for r in out.collect()), key=str)
    want = []
    for i, text, *_ in data:
        words = (text or "").split()
        runs = brute(words) if i != 900 else [(0, len(words), 4)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i, text, len(words), runs, " ".join(w for k, w in enumerate(words) if k not in gone)))
    assert got == sorted(want, key=str)
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_query(spark, tmp_path):
    data = rows()
    spark.createDataFrame(data, "doc_id long, text string, a string, b int, c int").write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for i, text, *_ in data:
        x = (text or "").split()
        h = crc32(str(i).encode())
        if i is not None and h % 10 == 0 and x:
            g = h // 10
            a = g % len(x)
            p = 1 + (len(x) - a) // (3 + g % 8)
            x = [x[k] if k < a else x[a + (k - a) % p] for k in range(len(x))]
        runs = brute(x) if len(x) < 10_000 else [(0, len(x), 4)]
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        kept = [w for k, w in enumerate(x) if not any(s + q <= k < s + n for s, n, q in runs)]
        want.append((i, len(runs), s, n, q, None if n is None else 1000 * n // q, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(kept))))
    got = periodic.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in got.dtypes[1:6]} == {"bigint"}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)

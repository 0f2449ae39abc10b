"""A minimiser over the bound never reaches a bucket's blobs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from skerry.llm import substring


def batches():
    rng = random.Random(7)
    make = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    phrase = make(30)  # in other surroundings each time: one distinct string for each document
    texts = [f"{make(40)} {phrase} {make(40)}".encode() for _ in range(200)] + [make(120).encode() for _ in range(50)]
    return [pa.RecordBatch.from_arrays([pa.array(range(i, i + 50)), pa.array(texts[i : i + 50], pa.binary())], ["doc_id", "text"]) for i in range(0, 250, 50)]


def packed_bytes(hot):
    held = {}
    for out in substring._pack(35, 5, 1, hot)(iter(batches())):
        for blob in out.column("blob").drop_null().to_pylist():
            t = pa.ipc.open_stream(blob).read_all()
            for mini, p in zip(t.column("mini").to_pylist(), t.column("packed").to_pylist()):
                held[mini] = held.get(mini, 0) + len(p)
    return held


def test_hot_minimisers_stay_out_of_memory():
    weight = {}
    for out in substring._weigh(35, 5)(iter(batches())):
        for mini, n in zip(out.column("mini").to_pylist(), out.column("bytes").to_pylist()):
            weight[mini] = weight.get(mini, 0) + n
    assert weight == packed_bytes(frozenset())
    limit = 20_000
    hot = frozenset(m for m, n in weight.items() if n > limit)
    assert hot and max(packed_bytes(hot).values()) <= limit
    sent = [w for out in substring._pack(35, 5, 4, hot)(iter(batches())) for w in out.column("packed").drop_null().to_pylist()]
    assert len(sent) > 1000 and all(len(w.split()) == 35 for w in sent)


def test_results_with_hot_minimisers(spark):
    rows = [r for b in batches() for r in b.to_pylist()]
    rows += [{"doc_id": 1000 + i, "text": rows[i]["text"]} for i in range(0, 250, 10)]
    df = spark.createDataFrame([(r["doc_id"], r["text"].decode()) for r in rows], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring.dedup_substrings(df, group_bytes=20_000).collect()}
    count = {}
    for r in rows:
        ws = r["text"].split()
        for i in range(len(ws) - 34):
            k = tuple(ws[i : i + 35])
            count[k] = count.get(k, 0) + 1
    for r in rows:
        ws = r["text"].split()
        gone = np.zeros(len(ws), bool)
        for i in range(len(ws) - 34):
            if count[tuple(ws[i : i + 35])] > 1:
                gone[i : i + 35] = True
        assert got[r["doc_id"]] == gone.sum()


def test_a_window_has_one_minimiser_wherever_it_is():
    """In a step of its own and in a long one, at its start, middle and end."""
    rng = np.random.default_rng(3)
    window = rng.integers(0, 1 << 32, 35).astype(np.uint64)
    alone = substring.super_kmers(window, np.array([35]), 35, 5)[2].tolist()
    for n in (100, 70_000, 600_000):
        for at in (0, n // 2, n):
            codes = np.concatenate([rng.integers(0, 1 << 32, at).astype(np.uint64), window, rng.integers(0, 1 << 32, n - at).astype(np.uint64)])
            firsts, sizes, minis = substring.super_kmers(codes, np.array([len(codes)]), 35, 5)
            assert minis[(firsts <= at) & (at < firsts + sizes)].tolist() == alone


def test_the_leftmost_of_equals():
    keys = np.array([3, 1, 1, 2, 1, 0, 0, 5], np.uint64)
    for width in range(1, 9):
        assert substring.leftmost_least(keys, width).tolist() == [i + int(np.argmin(keys[i : i + width])) for i in range(9 - width)]


def test_large_groups_are_counted_like_small_ones(monkeypatch):
    rng = random.Random(5)
    strings = Counter(" ".join(rng.choice("abc") for _ in range(rng.randrange(35, 50))).encode() for _ in range(300))
    strings += Counter({p: 1 for p in list(strings)[:9]})
    small = substring.repeated_windows(strings, 5)
    monkeypatch.setattr(substring, "SMALL_GROUP", 0)
    assert substring.repeated_windows(strings, 5) == small and any(map(any, small.values()))

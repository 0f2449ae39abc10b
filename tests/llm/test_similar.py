"""The near-dedup stage against brute force by 5-word Jaccard."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest

from skerry.llm import similar


def near_copies():
    rng = random.Random(9)
    make = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    rows = []
    for k in range(40):
        own = make(rng.randrange(20, 200))
        rows.append(" ".join(own))
        for _ in range(k % 4):  # copies with words changed in a few places
            copy = list(own)
            for at in rng.sample(range(len(own)), rng.randrange(1, 2 + len(own) // 30)):
                copy[at] = "changed"
            rows.append(" ".join(copy))
    chain = make(200)
    rows += [" ".join(chain[i : i + 160]) for i in range(0, 41, 8)]  # neighbours are similar, the ends are not
    rows += [rows[0], rows[0].upper(), "", " \n", "one two", "One  two"]
    return list(enumerate(rows))


def survivors(rows):
    sets = [similar.shingles(t.encode()) for _, t in rows]
    group = list(range(len(rows)))
    near = [[j for j in range(len(rows)) if len(x & sets[j]) >= 0.8 * len(x | sets[j])] for x in sets]
    for _ in rows:
        group = [min(group[j] for j in js) for js in near]
    return sorted(rows[g][0] for g in set(group))


@pytest.mark.parametrize("limits", [{}, {"FEW": 0}])
def test_copies_at_four_fifths_are_dropped(spark, monkeypatch, limits):
    """With FEW at 0, shared shingles are counted before any pair is looked at."""
    for name, value in limits.items():
        monkeypatch.setattr(similar, name, value)
    rows = near_copies()
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    assert got.columns == ["doc_id", "text"] and sorted(r.doc_id for r in got.collect()) == survivors(rows)


def test_rows_that_share_an_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, a), (1, b), (2, b), (2, b), (None, a + " tail"), (None, "c d e f g h")], "doc_id long, text string")
    got = similar.keep_one(df).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, a), (1, b), (0, "c d e f g h")])
    assert similar.keep_one(df.limit(0)).count() == 0


def test_sharing_finds_all_similar_items():
    rng = random.Random(5)
    base = [f"w{rng.randrange(300)}" for _ in range(80)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for at in rng.sample(range(80), rng.randrange(0, 8)):
            copy[at] = f"x{rng.randrange(9)}"
        texts.append(" ".join(copy[: rng.randrange(60, 81)]).encode())
    shard = similar.Shard(64, 5, 0.8)
    for i, t in enumerate(texts):
        shard.put(i, i, i, t)
    sets = [similar.shingles(t) for t in texts]
    for t, x in zip(texts, sets):
        assert shard._sharing(t).tolist() == [similar.alike(x, y, 0.8) for y in sets]


def test_links_in_small_trees(spark):
    """Shards that are cut into many trees give the same components."""
    rows = near_copies()
    texts = spark.createDataFrame([(i, t.encode()) for i, t in rows], "id long, text binary").persist()
    links = [(i, j) for i, x in rows for j, y in rows if i > j and similar.alike(similar.shingles(x.encode()), similar.shingles(y.encode()), 0.8)]
    members = spark.createDataFrame([(7, len(rows), 100, i, 0) for i, _ in rows], "bucket long, size long, bytes long, id long, fp long")
    none = spark.createDataFrame([], "id long, component long")
    for limits in ({}, {"tree": 9}, {"tree_bytes": 11}):
        got = {(r.a, r.b) for r in similar.across(members, none, texts, 5, 0.8, radius=64, **limits).collect()}
        group = {i: i for i, _ in rows}
        want = dict(group)
        for _ in rows:
            for pairs, label in ((got, group), (links, want)):
                for a, b in pairs:
                    label[a] = label[b] = min(label[a], label[b])
        assert group == want

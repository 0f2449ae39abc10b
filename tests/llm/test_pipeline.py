"""The pipeline against its stages by brute force on a small table, nulls and rows that share an id included."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_ops import SCHEMA, corpus, dropped_lines, measured, words

from skerry.llm import mixing, packing, quality, similar


def survivors(rows):
    """Of each component of texts at a 5-word Jaccard of 0.8 or more: its row with the smallest doc_id, the text telling ties apart."""
    sets = [similar.shingles((t or "").encode()) for _, t in rows]
    group = list(range(len(rows)))
    near = [[j for j in range(len(rows)) if len(x & sets[j]) >= 0.8 * len(x | sets[j])] for x in sets]
    for _ in rows:
        group = [min(group[j] for j in js) for js in near]
    members = defaultdict(list)
    for g, r in zip(group, rows):
        members[g].append(r[0])
    return Counter(min(ids, key=lambda i: (i is None, i or 0)) for ids in members.values())


def mixed_well(before, after):
    """By words, not by the stage's own rule: the budget is met and not exceeded, sources come near their targets, no row more than three times."""
    size = lambda t: len(words(t))
    budget = sum(size(r.text) for r in before.collect())
    got = Counter()
    for r in after.collect():
        got[r.source] += size(r.text)
    longest = max((size(r.text) for r in before.collect()), default=0)
    target = {r.source: r.target for r in mixing.mix(before).collect()}
    assert sum(got.values()) <= budget and sum(got.values()) == sum(r.taken for r in mixing.mix(before).collect())
    assert all(abs(got[s] - t) <= longest for s, t in target.items())
    had, has = (Counter((r.doc_id, r.text, r.source) for r in d.collect()) for d in (before, after))
    assert all(n <= (3 if size(row[1]) else 1) * had[row] for row, n in has.items())


def test_mixing_rows_that_share_an_id(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 7, i]), " ".join(["w"] * rng.randrange(1, 90)), rng.choice(["a", "b", "c", None]), i) for i in range(900)]
    docs = spark.createDataFrame(rows + rows[:40] * 5, "doc_id long, text string, source string, row int")
    mixed_well(docs, mixing.mixed_documents(docs))


@pytest.mark.parametrize("budget", [0, 1, 500, 4_000, 10**9])
def test_where_the_budget_ends(spark, budget):
    rows = [(i % 7 + 1, float(i // 3), f"{i * 7919 % 1000:03d}") for i in range(1000)]
    total, want = 0, None
    for n, finish, key in sorted(rows, key=lambda r: r[1:]):
        total += n
        if total > budget:
            want = (finish, key)
            break
    df = spark.createDataFrame(rows, "size long, finish double, key string").repartition(3)
    assert mixing.first_over(df, budget) == mixing.first_over(df, budget, few=5) == want


@pytest.mark.parametrize("ids", [True, False])
def test_stages(spark, tmp_path, ids):
    rows = [r for r in corpus() if r[0] is not None or not ids]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / f"stage{k}")
        stage(spark, kept[-1], str(tmp_path)).write.parquet(path)
        kept.append(spark.read.parquet(path))
    assert all(d.columns == columns for d in kept[:-1])
    as_rows = lambda d: [(r.doc_id, r.text) for r in d.collect()]

    good = Counter((r.doc_id, r.text) for r in quality.quality(docs).where("___kept").collect())
    assert set(good) <= {(r[0], r[1]) for r in rows if not measured(r[1])[-1]}
    assert Counter(as_rows(kept[1])) == good
    assert Counter(as_rows(kept[2])) == Counter((i, t) for i, _, _, t in dropped_lines(as_rows(kept[1])))
    assert Counter(i for i, _ in as_rows(kept[3])) == survivors(as_rows(kept[2]))
    mixed_well(kept[3], kept[4])
    packed = kept[5].where("piece = 0").groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in packed} == Counter(i for i, _ in as_rows(kept[4]))
    assert kept[5].groupBy("sequence_id").sum("length").where(f"`sum(length)` > {packing.CAPACITY}").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept[5].count()


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

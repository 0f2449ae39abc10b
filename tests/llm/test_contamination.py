"""Benchmark windows against plain search, in one broadcast set and in many."""

from __future__ import annotations

import random
import re

import pytest

from skerry.llm import common, contamination


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def tables():
    rng = random.Random(4)
    make = lambda n: " ".join(rng.choice(["The", "of,", "x-y", "É", "straße", *map(str, range(12)), *[f"w{i}" for i in range(25)]]) for _ in range(n))
    items = [(i, make(rng.randrange(11, 40))) for i in range(12)]
    items += [(50, "short Item here"), (51, "one"), (52, make(10)), (53, None), (54, "!!! ,"), (55, items[0][1]), (0, make(14)), (None, make(13))]
    passage = lambda: rng.choice(items)[1] or ""
    docs = [(i, f"{make(rng.randrange(30))}. {passage().upper() if i % 3 else make(8)}; {make(9)}\n{passage()[: rng.randrange(20, 200)]}") for i in range(60)]
    docs += [(100, None), (101, ""), (102, " .\n"), (103, "SHORT item, HERE"), (None, items[1][1]), docs[1], docs[1]]
    docs += [(104, f"{make(common.STEP_BYTES // 4)} {items[2][1]} {make(40)}")]  # longer than a step
    return docs, items


def brute(docs, items, size):
    grams = set()
    for i, text in items:
        ws = words(text)
        k = min(size, len(ws))
        grams |= {(tuple(ws[j : j + k]), "" if i is None else str(i)) for j in range(len(ws) - k + 1) if k}
    by = {}
    for g, i in grams:
        by.setdefault(g, set()).add(i)
    out = []
    for i, text in docs:
        ws, hit, own = words(text), set(), set()
        for k in {len(g) for g in by}:
            for j in range(len(ws) - k + 1):
                if found := by.get(tuple(ws[j : j + k])):
                    hit |= set(range(j, j + k))
                    own |= found
        out.append((i, text, len(ws), hit, sorted(own)))
    return out


@pytest.fixture(scope="module")
def both(spark):
    docs, items = tables()
    return docs, items, spark.createDataFrame([(*d, 7, 8) for d in docs], "doc_id long, text string, spans int, __items int").repartition(3), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, window int")


@pytest.mark.parametrize("set_bytes", [contamination.SET_BYTES, 6_000])
def test_spans_and_items(both, set_bytes):
    docs, items, docs_df, items_df = both
    out = contamination.contamination(docs_df, items_df, set_bytes=set_bytes)
    assert out.columns == [*docs_df.columns, "__n_words", "__spans", "___items"]
    got = [(r[0], r[1], r[4], {k for s in r[5] for k in range(s["start"], s["end"])}, list(r[6])) for r in out.collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items, 10), key=str)


def test_removal(both):
    docs, items, docs_df, items_df = both
    want = brute(docs, items, 10)
    clean = contamination.decontaminated(docs_df, items_df, whole=True)
    assert sorted((tuple(r)[:2] for r in clean.collect()), key=str) == sorted(((i, t) for i, t, _, hit, _ in want if not hit), key=str)
    cut = contamination.decontaminated(docs_df, items_df)
    assert cut.columns == docs_df.columns
    kept = lambda t, hit: [w for k, w in enumerate(words(t)) if k not in hit]
    assert sorted(((r[0], words(r[1])) for r in cut.collect()), key=str) == sorted(((i, kept(t, hit)) for i, t, _, hit, _ in want), key=str)
    assert {r[1] for r in cut.where("doc_id IN (100, 102)").collect()} == {None, " .\n"}
    assert contamination.cut("Keep, Cut-THIS now; keep", [{"start": 1, "end": 4}]) == "Keep, ; keep"


def test_empty_tables(both):
    _, _, docs_df, items_df = both
    assert contamination.contamination(docs_df.limit(0), items_df).count() == 0
    assert contamination.contamination(docs_df, items_df.limit(0)).where("size(__spans) > 0 OR size(___items) > 0").count() == 0

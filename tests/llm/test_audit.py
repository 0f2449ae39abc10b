"""Filter audit against every order applied document by document, and carry-save counts against plain ones."""

from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
import pytest

from skerry.llm import audit, common


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 64, 1000, 4097])
def test_positional_counts(n):
    w = np.random.default_rng(n).integers(0, 1 << 32, n).astype(np.uint32)
    assert audit.positional_counts(w).tolist() == [int((w >> k & 1).sum()) for k in range(32)]


def test_survival_words():
    w = audit.survival_words(5)
    assert len(w) == 32 and all((int(w[m]) >> s & 1) == (m & s == 0) for m in range(32) for s in range(32))


def tables():
    rng = random.Random(6)
    make = lambda n, k: " ".join(rng.choice([*[f"w{i}" for i in range(k)], "É"]) for _ in range(n))
    texts = [make(rng.choice([5, 199, 200, 260]), rng.choice([20, 99, 400])) + rng.choice(["", " # ", " X", " ABCDEFGHIJKLMNOP", " STUVÄÖ" * 9]) for _ in range(70)]
    texts += texts[:25] + [texts[1]] * 9 + ["", None, " ", "AB " * common.STEP_BYTES]
    docs = [(i, t, rng.choice(["en", "de", "", None]), 1) for i, t in enumerate(texts)]
    rng.shuffle(docs)
    docs += [docs[0], docs[0], (None, texts[1], "en", 1), (None, "only here", "fr", 1), (docs[2][0], docs[2][1], "fr", 1)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 110, 2)]
    return docs, [*labels, (4, 1, 1), (4, 0, 0), (None, 1, 1)]


def brute(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    fails = []
    for i, text, part, _ in docs:
        t = text or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {c for c, bad in zip("ABCD", (len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), re.search("[#$%&*|]", t))) if bad}
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _, _ in docs):
            f.add("E")
        fails.append((part or "", f, i in good, i in toxic))
    out, total = [], {}
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in permutations("ABCDE"):
            for k, c in enumerate(order):
                here = [f for f in own if not f[1] & set(order[:k])]
                gone = [f for f in here if c in f[1]]
                total[part, c] = total.get((part, c), 0) + len(gone)
                out.append((part, "".join(order), k + 1, len(here) - len(gone), len(gone), sum(c in f[1] for f in own) - len(gone), sum(f[1] == {c} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone)))
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def test_audit(spark):
    docs, labels = tables()
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, lang string, mask int, part int").repartition(3)
    l = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string").repartition(2)
    got = audit.audit(d, l)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == brute(docs, labels)
    assert audit.audit(d.limit(0), l).count() == 0
    assert {(r.good_lost, r.toxic_lost) for r in audit.audit(d, l.limit(0)).collect()} == {(0, 0)}


def test_other_filters(spark):
    """Fewer filters: two orders of two."""
    d = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b" * 9, "x")], "doc_id long, text string, lang string")
    l = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in audit.audit(d, l, names=("A",)).collect()}
    assert got == {("AE", 1): (0, 3, 0), ("AE", 2): (0, 0, 1), ("EA", 1): (2, 1, 0), ("EA", 2): (0, 2, 1)}

"""Documents that pass the base rules and that long repeats alone reject."""

from __future__ import annotations

from skerry.llm import quality


def test_each_limit_rejects_by_itself(spark):
    block = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    one = block("a", 45)
    many = " ".join(block(c, 18) for c in "cdef")
    texts = {
        1: block("x", 400),
        2: f"{one} {block('x', 310)} {one}",  # 22.5 % covered, the longest 11.25 %
        3: f"{many} {block('x', 370)} {block('f', 18)} {block('e', 18)} {block('d', 18)} {block('c', 18)}",  # 28 % covered, the longest 3.5 %
        4: f"{block('a', 30)} {block('x', 250)} {block('a', 30)}",  # 19 % covered, the longest 9.7 %
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert not any(r["__base_failed"] for r in quality.quality(df).collect())
    assert sorted(r.doc_id for r in quality.keep_good(df).collect()) == [1, 4]
    assert sorted(r.doc_id for r in quality.keep_good(df, max_longest=1).collect()) == [1, 2, 4]
    assert sorted(r.doc_id for r in quality.keep_good(df, max_covered=1).collect()) == [1, 3, 4]

"""Filter interaction audit: a truth-table word for each document, carry-save counts of its bits, and every order of the filters from them."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import steps, table, written

_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"

#: The filters that a text alone decides, by letter: whether it fails. E, a copy of an earlier document, needs all of them.
TEXT_FILTERS: dict[str, Callable[[bytes, list[bytes]], bool]] = {
    "A": lambda text, words: len(words) < 200,
    "B": lambda text, words: 100 * len(set(words)) < 50 * len(words),
    "C": lambda text, words: 100 * (len(text) - len(text.translate(None, _UPPER))) > 3 * (len(text) if text.isascii() else len(text.decode("utf-8", "replace"))),
    "D": lambda text, words: len(text.translate(None, _MARKS)) < len(text),
}
COPY = "E"


def survival_words(n: int) -> np.ndarray:
    """For each mask of failed filters, n of them: a word whose bit S is set if a document that fails these survives the subset S of filters."""
    subsets = np.arange(1 << n)
    return np.array([sum(1 << int(s) for s in subsets[subsets & mask == 0]) for mask in range(1 << n)], np.uint64 if n > 5 else np.uint32)


def positional_counts(words: np.ndarray) -> np.ndarray:
    """How many of the words have each bit set.

    Carry-save: a full adder turns three words of one weight into a sum of that weight and a carry of twice it, bit by bit,
    until no weight has more than two words. Only these are taken apart.
    """
    bits = words.dtype.itemsize * 8
    total, layers = np.zeros(bits, np.int64), {0: words}
    at = 0
    while at in layers:
        own = layers[at]
        while len(own) > 2:
            third = len(own) // 3
            a, b, c = own[:third], own[third : 2 * third], own[2 * third : 3 * third]
            half = a ^ b
            carry = (a & b) | (half & c)
            layers[at + 1] = np.r_[layers[at + 1], carry] if at + 1 in layers else carry
            own = np.r_[half ^ c, own[3 * third :]]
        for w in own.tolist():
            total += (np.uint64(w) >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.int64) << at
        at += 1
    return total


def _masks(names: Sequence[str]):
    """(doc_id, part, mask, copy): which text filters fail, and 128 bits of the text."""
    tests = [TEXT_FILTERS[n] for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            masks, digests = [], []
            for text in batch.column("text").to_pylist():
                text = text or b""
                words = text.split()
                masks.append(sum(fails(text, words) << k for k, fails in enumerate(tests)))
                digests.append(xxhash.xxh3_128_digest(text))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "copy"])

    return run


def _counted(n: int):
    """(part, label, counts): the positional counts of a batch's survival words."""
    table_ = survival_words(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            names = batch.column("part").dictionary_encode()
            part, mask = names.indices.to_numpy(), batch.column("mask").to_numpy()
            labels = {"all": np.ones(len(mask), bool), "good": batch.column("good").to_numpy(zero_copy_only=False), "toxic": batch.column("toxic").to_numpy(zero_copy_only=False)}
            order = np.argsort(part, kind="stable")
            bounds = np.r_[0, np.cumsum(np.bincount(part, minlength=len(names.dictionary)))]
            for k, name in enumerate(names.dictionary.to_pylist()):
                rows = order[bounds[k] : bounds[k + 1]]
                for label, flags in labels.items():
                    out.append((name, label, positional_counts(table_[mask[rows[flags[rows]]]])[: 1 << n].tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.list_(pa.int64()))], ["part", "label", "counts"])

    return run


def failures(docs: DataFrame, labels: DataFrame, part: str = "lang", names: Sequence[str] = tuple(TEXT_FILTERS)) -> DataFrame:
    """(doc_id, part, mask, good, toxic) for each row of docs: bit k of the mask is set where the k-th of the named filters fails, the last bit where the text is a smaller doc_id's too.

    What a text alone decides takes one scan; what goes on is some forty bytes a row. The smallest doc_id of each text comes from
    one aggregation, combined before it moves, and is joined back on text and doc_id: copies of one text, however many, meet in
    no task. Rows without a doc_id go past the joins.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    thin = written(own.mapInArrow(_masks(names), "doc_id long, part string, mask int, copy binary"), "masks")
    known = thin.where("doc_id IS NOT NULL")
    firsts = known.groupBy("copy").agg(F.min("doc_id").alias("first")).withColumnRenamed("copy", "of")
    joined = known.join(firsts, (known["copy"] == firsts["of"]) & (known["doc_id"] == firsts["first"]), "left")
    flagged = joined.select("doc_id", "part", F.when(F.col("first").isNull(), F.col("mask") + (1 << len(names))).otherwise(F.col("mask")).alias("mask"))
    own = labels.groupBy(F.col("doc_id").cast("long").alias("of")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    flag = lambda c: (F.coalesce(c, F.lit(0)) == 1).alias(c)
    labelled = flagged.join(own, flagged["doc_id"] == own["of"], "left").select("doc_id", "part", "mask", flag("good"), flag("toxic"))
    return labelled.unionByName(thin.where("doc_id IS NULL").select("doc_id", "part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic")))


def survivors(docs: DataFrame, labels: DataFrame, part: str = "lang", names: Sequence[str] = tuple(TEXT_FILTERS)) -> DataFrame:
    """(part, label, subset, n): documents of a part, and of its good and toxic ones, that survive each subset of the filters; a subset is a mask."""
    rows = failures(docs, labels, part, names).drop("doc_id")
    counted = rows.mapInArrow(_counted(len(names) + 1), "part string, label string, counts array<long>")
    each = counted.select("part", "label", F.posexplode("counts").alias("subset", "n"))
    return each.groupBy("part", "label", "subset").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", names: Sequence[str] = tuple(TEXT_FILTERS)) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part and each order of the filters.

    All of it follows from how many documents survive each subset: what a step removes is the difference of two of these.
    A part is a value of the column; a null one is an empty string. Null texts are empty. A row without a doc_id has no
    label and is nobody's copy; of rows that share a doc_id and a text none is the other's. Labels are joined by
    doc_id; where several rows have one, the larger counts. Other columns of docs stay behind; an empty table gives no parts.
    """
    letters = [*names, COPY]
    orders = []
    for order in permutations(range(len(letters))):
        before = 0
        for step, k in enumerate(order):
            orders.append({"filter_order": "".join(letters[j] for j in order), "step": step + 1, "own": 1 << k, "before": before, "after": before | 1 << k})
            before |= 1 << k
    every = (1 << len(letters)) - 1
    wide = survivors(docs, labels, part, names).groupBy("part").pivot("label", ["all", "good", "toxic"]).agg(F.array_sort(F.collect_list(F.struct("subset", "n"))))  # 2 ** filters a list
    kind = "array<struct<filter_order: string, step: int, own: int, before: int, after: int>>"
    rows = wide.select("part", *[F.transform(F.col(c), lambda x: x["n"]).alias(c) for c in ("all", "good", "toxic")], F.explode(F.from_json(F.lit(json.dumps(orders)), kind)).alias("o")).select("part", "all", "good", "toxic", "o.*")
    at = lambda c, mask: F.get(c, mask)
    lost = lambda c: at(c, F.col("before")) - at(c, F.col("after"))
    rows = rows.select(
        "part", "filter_order", "step", at("all", F.col("after")).alias("kept"), lost("all").alias("removed"), (at("all", F.lit(0)) - at("all", F.col("own")) - lost("all")).alias("redundant"),
        (at("all", every - F.col("own")) - at("all", F.lit(every))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), "own",
    )
    return rows.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "own"))).drop("own")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH words AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
marked AS (
  SELECT rid, doc_id, part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b,
         100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e
  FROM words),
lab AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
flags AS (SELECT m.rid, part, f.letter, f.fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM marked m LEFT JOIN lab USING (doc_id), unnest([{'letter': 'A', 'fails': a}, {'letter': 'B', 'fails': b}, {'letter': 'C', 'fails': c}, {'letter': 'D', 'fails': d}, {'letter': 'E', 'fails': e}]) AS u(f)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters p, letters q, letters r, letters s, letters t
  WHERE p.x <> q.x AND p.x <> r.x AND p.x <> s.x AND p.x <> t.x AND q.x <> r.x AND q.x <> s.x AND q.x <> t.x AND r.x <> s.x AND r.x <> t.x AND s.x <> t.x),
doc AS (SELECT rid, part, any_value(good) AS good, any_value(toxic) AS toxic, string_agg(letter, '' ORDER BY letter) FILTER (fails) AS failed FROM flags GROUP BY rid, part),
kinds AS (SELECT part, coalesce(failed, '') AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM doc GROUP BY ALL),
steps AS (SELECT part, filter_order, step, substr(filter_order, step, 1) AS letter, failed, n, good, toxic,
         regexp_matches(failed, '[' || substr(filter_order, step, 1) || ']') AS own, step > 1 AND regexp_matches(failed, '[' || substr(filter_order, 1, greatest(step - 1, 1)) || ']') AS earlier
  FROM kinds, orders, range(1, 6) AS g(step)),
sums AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, letter, sum(CASE WHEN NOT own AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN own AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN own AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failed = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN own AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN own AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM sums
"""

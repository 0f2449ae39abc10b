"""Quality rules: word and symbol counts, and suffix-array repetition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import WHITE, numbered, steps, table, unused

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
#: Repeats of this many words count as long; the share of words in them, and the longest one's share of the text, are limited.
MIN_REPEAT = 16
MAX_COVERED = 0.3
MAX_LONGEST = 0.2
#: Limits of keep_good, below what the base rule leaves: two copies of a passage of over 10 % cover over 20 %.
KEEP_COVERED = 0.25
KEEP_LONGEST = 0.1


def word_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One integer for each word of all texts, equal for equal words, and the number of words of each text."""
    split = [t.split() for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    words = pa.array([w for ws in split for w in ws], pa.binary()).dictionary_encode()
    return words.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def longest_repeats(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each place: the words of the longest substring from there that its own text holds twice.

    Suffixes are ranked by prefix doubling within their text, and only those whose rank is still shared go on. Neighbours
    in the finished suffix array have the longest common prefixes; the larger one of a suffix's two is the depth of the
    smallest prefix interval around it, a maximal repeated substring.
    """
    n = len(codes)
    if n < 2:
        return np.zeros(n, np.int64)
    text = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(np.cumsum(counts), counts)
    _, first_rank, sizes = np.unique(text * (codes.max() + 1) + codes, return_inverse=True, return_counts=True)
    rank = (np.cumsum(sizes) - sizes)[first_rank].astype(np.int32)  # the place of its group in the order so far
    places = np.flatnonzero(sizes[first_rank] > 1)
    ranks, width = [rank], 1
    while len(places):
        ahead = places + width
        second = np.where(ahead < end[places], rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[places].astype(np.int64) * (n + 1) + second
        order = np.argsort(key)
        places, key = places[order], key[order]
        head = rank[places]
        at = np.arange(len(places), dtype=np.int32)
        new = np.r_[True, key[1:] != key[:-1]]
        group = np.maximum.accumulate(np.where(np.r_[True, head[1:] != head[:-1]], at, 0))
        rank = rank.copy()
        rank[places] = head + np.maximum.accumulate(np.where(new, at, 0)) - group
        ranks.append(rank)
        width *= 2
        sizes = np.diff(np.append(np.flatnonzero(new), len(places)))
        places = places[np.repeat(sizes > 1, sizes)]
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    common, end_a, end_b = np.zeros(n - 1, np.int64), end[order[:-1]], end[order[1:]]
    pairs = np.flatnonzero((text[a] == text[b]) & (codes[a] == codes[b]))
    for k in range(len(ranks) - 1, -1, -1):  # a shared rank of level k: 2 ** k words are equal
        i = pairs[(a[pairs] + (1 << k) <= end_a[pairs]) & (b[pairs] + (1 << k) <= end_b[pairs])]
        i = i[ranks[k][a[i]] == ranks[k][b[i]]]
        common[i] += 1 << k
        a[i] += 1 << k
        b[i] += 1 << k
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in the union of the spans."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_long_repeat_words", "longest_repeat")


def measures(texts: list[bytes], window: int = WINDOW, min_repeat: int = MIN_REPEAT) -> dict[str, np.ndarray]:
    """MEASURES of whole texts."""
    codes, counts = word_codes(texts)
    longest = longest_repeats(codes, counts)
    bounds = np.r_[0, np.cumsum(counts)]

    def by_text(flags: np.ndarray) -> np.ndarray:
        before = np.r_[0, np.cumsum(flags)]
        return before[bounds[1:]] - before[bounds[:-1]]

    twice, long_ = np.flatnonzero(longest >= window), np.flatnonzero(longest >= min_repeat)
    tops = np.zeros(len(texts), np.int64)
    np.maximum.at(tops, np.repeat(np.arange(len(texts)), counts), longest)
    bare = [t.translate(None, WHITE) for t in texts]
    lines = []
    for t in texts:
        own = [x for x in t.split(b"\n") if x.strip(WHITE)] if b"\n" in t else ()
        lines.append(len(own) - len(set(own)))
    return {
        "n_words": counts,
        "word_chars": np.array([len(b) if b.isascii() else len(b.decode("utf-8", "replace")) for b in bare], np.int64),
        "n_symbols": np.array([len(b) - len(b.translate(None, SYMBOLS)) for b in bare], np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": by_text(covered(twice, longest[twice], len(codes))),
        "n_long_repeat_words": by_text(covered(long_, longest[long_], len(codes))),
        "longest_repeat": tops,
    }


def _judge(window: int, min_repeat: int, max_covered: float, max_longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            m = measures([t or b"" for t in batch.column("text").to_pylist()], window, min_repeat)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
            kept = ~failed & (m["n_long_repeat_words"] <= max_covered * m["n_words"]) & ((m["longest_repeat"] < min_repeat) | (m["longest_repeat"] <= max_longest * m["n_words"]))
            columns = [*batch.columns, *[pa.array(m[k], pa.int64()) for k in MEASURES], pa.array(failed), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *MEASURES, "base_failed", "kept"])

    return run


def _judged(docs: DataFrame, window: int, min_repeat: int, max_covered: float, max_longest: float) -> tuple[DataFrame, dict[str, str]]:
    """docs with numbered columns, the measures and verdicts behind them; a text travels once."""
    plain, columns = numbered(docs)
    text = columns["text"]
    rest = [c for c in columns.values() if c != text]
    kinds = [f"{c} {plain.schema[c].dataType.simpleString()}" for c in rest] + ["text binary"] + [f"{k} long" for k in MEASURES] + ["base_failed boolean", "kept boolean"]
    out = plain.select(*rest, F.col(text).cast("binary").alias("text")).mapInArrow(_judge(window, min_repeat, max_covered, max_longest), ", ".join(kinds))
    return out.withColumn(text, F.col("text").cast(plain.schema[text].dataType)), columns


def quality(docs: DataFrame, window: int = WINDOW, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """docs with the columns __n_words, __word_chars, __n_symbols, __n_dup_lines, __n_repeat_words, __n_long_repeat_words, __longest_repeat, __base_failed, __kept.

    One pass without a shuffle: a text is judged by itself. Null and blank texts have no words and fail. All columns of
    docs stay, whatever their names (a new column whose name is taken gets more underscores); repeated rows are judged
    alike; an empty table stays empty.
    """
    out, columns = _judged(docs, window, min_repeat, max_covered, max_longest)
    new = (*MEASURES, "base_failed", "kept")
    return out.select(*columns.values(), *new).toDF(*docs.columns, *unused(docs.columns, *[f"__{k}" for k in new]))


def keep_good(docs: DataFrame, max_covered: float = KEEP_COVERED, max_longest: float = KEEP_LONGEST) -> DataFrame:
    """docs without the rows that the rules reject, long repeats by limits of its own."""
    out, columns = _judged(docs, WINDOW, MIN_REPEAT, max_covered, max_longest)
    return out.where("kept").select(*columns.values()).toDF(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", *[F.col(f"__{k}").alias(k) for k in (*MEASURES[:5], "base_failed", "kept")])


OP6_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT rid, len(ws) AS n, greatest(16, CAST(floor(0.2::DOUBLE * len(ws)) AS BIGINT) + 1) AS m, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM texts),
windows AS (
  SELECT rid, n, m, pos, word,
         string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS k8,
         string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 15 FOLLOWING) AS k16,
         string_agg(word, ' ') OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND m - 1 FOLLOWING) AS km
  FROM words),
repeated AS (
  SELECT rid, n, pos, word,
         CAST(pos + 7 <= n AND count(*) FILTER (pos + 7 <= n) OVER (PARTITION BY rid, k8) > 1 AS INT) AS r8,
         CAST(pos + 15 <= n AND count(*) FILTER (pos + 15 <= n) OVER (PARTITION BY rid, k16) > 1 AS INT) AS r16,
         CAST(pos + m - 1 <= n AND count(*) FILTER (pos + m - 1 <= n) OVER (PARTITION BY rid, km) > 1 AS INT) AS rm
  FROM windows),
covered AS (
  SELECT rid, n, word, rm, max(r8) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS c8,
         max(r16) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS c16
  FROM repeated),
sums AS (SELECT rid, sum(length(word))::BIGINT AS chars, sum(c8)::BIGINT AS c8, sum(c16)::BIGINT AS c16, max(rm) AS rm FROM covered GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS dups FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM texts) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
base AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dups, 0) AS n_dup_lines, coalesce(c8, 0) AS n_repeat_words, coalesce(c16, 0) AS c16, coalesce(rm, 0) AS rm
  FROM texts LEFT JOIN sums USING (rid) LEFT JOIN lines USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND c16 <= 0.3::DOUBLE * n_words AND rm = 0 AS kept
FROM base
"""

"""Benchmark decontamination: a broadcast set of hashed benchmark n-grams, training windows held against it, hits verified word by word."""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import numbered, steps, table, unused, written

WINDOW = 10
#: Bytes of windows in one broadcast set. A larger benchmark is cut into several sets, each of which scans the documents.
SET_BYTES = 32 << 20
#: Words are runs of a-z, 0-9 and everything that is not ASCII, once A-Z is lower case; here all other bytes are blanks.
_PLAIN = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))
#: Upper bits of a hash that a first look goes by.
_LOOK = 22
_RUN = re.compile(rb"[^ ]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_PLAIN).split()


def windows_of(words: list[bytes], size: int) -> list[bytes]:
    """Runs of `size` words; of fewer words, all of them; of none, none."""
    return [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of `width` codes."""
    n = len(codes) - width + 1
    h = np.zeros(max(0, n), np.uint64)
    for j in range(width if n > 0 else 0):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : n + j] + np.uint64(1)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _codes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.uint64, len(words))


class GramSet:
    """Windows of one set, by their number of words: sorted hashes, a table of their upper bits, and the items that each window is from."""

    def __init__(self, rows: list[tuple[bytes, str]]) -> None:
        self.items = defaultdict(set)
        for window, item in rows:
            self.items[window].add(item)
        by_width = defaultdict(list)
        for window in self.items:
            words = window.split(b" ")
            by_width[len(words)].append(hashes(_codes(words), len(words))[0])
        self.sets = {}
        for width, own in by_width.items():
            own, look = np.unique(np.array(own, np.uint64)), np.zeros(1 << _LOOK, bool)
            look[own >> np.uint64(64 - _LOOK)] = True
            self.sets[width] = own, look

    def hits(self, words: list[list[bytes]]) -> Iterator[tuple[int, int, int, set[str]]]:
        """(text, first word, words, items) of each occurrence of a window in the texts."""
        counts = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(counts)
        codes = _codes([w for ws in words for w in ws])
        end = np.repeat(ends, counts)
        for width, (own, look) in self.sets.items():
            h = hashes(codes, width)
            at = np.flatnonzero(look[h >> np.uint64(64 - _LOOK)])
            at = at[own[np.minimum(np.searchsorted(own, h[at]), len(own) - 1)] == h[at]]
            at = at[at + width <= end[at]]
            for place, i in zip(at.tolist(), np.searchsorted(ends, at, side="right").tolist()):
                start = place - int(ends[i] - counts[i])
                items = self.items.get(b" ".join(words[i][start : start + width]))
                if items:  # else another window with the same hash
                    yield i, start, width, items


_HELD: dict[str, GramSet] = {}


def _set(name: str, sent: Broadcast) -> GramSet:
    """A worker holds the set that it used last."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = GramSet(sent.value)
    return _HELD[name]


def _scan(sent: Broadcast):
    """Adds a set's spans and items to those that earlier sets have found."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _set(name, sent)
        for batch in steps(batches):
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            spans, items = defaultdict(list), defaultdict(set)
            for i, start, width, own in grams.hits(words):
                spans[i].append((start, start + width))
                items[i] |= own
            out_spans, out_items = [], []
            for i, (before, known) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist())):
                joined = []
                for a, b in sorted([*((s["start"], s["end"]) for s in before), *spans.get(i, ())]):
                    if joined and a <= joined[-1][1]:
                        joined[-1][1] = max(b, joined[-1][1])
                    else:
                        joined.append([a, b])
                out_spans.append([{"start": a, "end": b} for a, b in joined])
                out_items.append(sorted({*known, *items.get(i, ())}))
            rest = batch.drop_columns(["n_words", "spans", "items"])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            new = [pa.array(list(map(len, words)), pa.int64()), pa.array(out_spans, span), pa.array(out_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*rest.columns, *new], [*rest.schema.names, "n_words", "spans", "items"])

    return run


def _windows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=1 << 18):
            rows = [(i, w) for i, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()) for w in windows_of(words_of(t), size)]
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.binary()), pa.array([r[0] for r in rows], pa.string())], ["window", "item"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """docs with the columns __n_words, __spans (start, end in words; joined where they touch) and __items (ids as strings, sorted).

    A window is `size` consecutive words of a benchmark (item_id, text) row; a row of fewer words is one window, a row of none has
    none. Rows that share an item_id are one item; a null id counts as an empty string. The windows are counted in bytes first: up to `set_bytes` they
    are one broadcast set, more are dealt into sets of about that size by a hash of window and item, and each set has a scan of its own,
    written before the next. So neither driver nor task holds more than a set, and documents are never shuffled. Null and
    blank texts have no words; repeated rows are judged alike; all columns stay, whatever their names (a new name that is taken
    gets more underscores); an empty table on either side gives no hits.
    """
    spark = docs.sparkSession
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    grams = written(own.mapInArrow(_windows(size), "window binary, item string").distinct(), "grams")
    total = grams.agg(F.sum(F.octet_length("window") + F.octet_length("item"))).first()[0] or 0
    sets = max(1, -(-total // set_bytes))
    dealt = grams.withColumn("part", F.pmod(F.xxhash64("window", "item"), F.lit(sets)))
    plain, columns = numbered(docs)
    text = columns["text"]
    rest = [c for c in columns.values() if c != text]
    kinds = [f"{c} {plain.schema[c].dataType.simpleString()}" for c in rest] + ["text binary, n_words long, spans array<struct<start: long, end: long>>, items array<string>"]
    out = plain.select(*rest, F.col(text).cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start: long, end: long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for part in range(sets):
        sent = spark.sparkContext.broadcast([(bytes(r.window), r.item) for r in dealt.where(F.col("part") == part).select("window", "item").collect()])
        out = out.mapInArrow(_scan(sent), ", ".join(kinds))
        if part < sets - 1:
            out = written(out, "scanned")
    out = out.withColumn(text, F.col("text").cast(plain.schema[text].dataType))
    new = ("n_words", "spans", "items")
    return out.select(*columns.values(), *new).toDF(*docs.columns, *unused(docs.columns, *[f"__{k}" for k in new]))


def cut(text: str | None, spans: list) -> str | None:
    """text without the words of the spans: what stands between a span's first and last word goes with them, all else stays."""
    if text is None or not spans:
        return text
    raw = text.encode()
    places, out, at = [m.span() for m in _RUN.finditer(raw.translate(_PLAIN))], [], 0
    for s in spans:
        out.append(raw[at : places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return b"".join([*out, raw[at:]]).decode()


def decontaminated(docs: DataFrame, benchmark: DataFrame, whole: bool = False, size: int = WINDOW, set_bytes: int = SET_BYTES) -> DataFrame:
    """docs without the words that benchmark windows cover, or (whole) without the rows that hold one. Columns stay as they are."""
    out, n = contamination(docs, benchmark, size, set_bytes), len(docs.columns)
    out = out.toDF(*[f"c{i}" for i in range(n)], "n_words", "spans", "items")
    if whole:
        return out.where(F.size("spans") == 0).select(*[f"c{i}" for i in range(n)]).toDF(*docs.columns)
    text = f"c{docs.columns.index('text')}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text):
            new = [x if not s else cut(x.decode(), s).encode() for x, s in zip(batch.column(text).to_pylist(), batch.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.binary()) if c == text else batch.column(c) for c in batch.schema.names if c != "spans"], [c for c in batch.schema.names if c != "spans"])

    plain = out.select(*[F.col(f"c{i}").cast("binary").alias(text) if f"c{i}" == text else f"c{i}" for i in range(n)], "spans")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[:-1])
    return plain.mapInArrow(run, kinds).withColumn(text, F.col(text).cast(docs.schema["text"].dataType)).toDF(*docs.columns)


def op12_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.size("__spans") > 0).alias("contaminated"))


OP12_SQL = r"""
WITH clean AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bench AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS width, array_to_string(list_slice(ws, i, i + least(10, len(ws)) - 1), ' ') AS k
  FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM bench WHERE len(ws) > 0)),
widths AS (SELECT DISTINCT width FROM grams),
windows AS (
  SELECT rid, i, width, array_to_string(list_slice(ws, i, i + width - 1), ' ') AS k
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM clean), widths WHERE i + width - 1 <= len(ws)),
hits AS (SELECT rid, i, width, item_id FROM windows JOIN grams USING (width, k)),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + width)) AS p FROM hits) GROUP BY rid),
hit_items AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM clean LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""

"""Substring deduplication by super-k-mer partitioning: windows that share a minimiser travel as one packed string to its bucket."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import id_and_text, slots, steps, table, written

WINDOW = 35
MER = 5
#: Bytes of packed strings that a bucket should hold, before compression.
BUCKET_BYTES = 8 << 20
#: Bytes of text that are packed together.
STEP = 2 << 20
#: Bytes of packed strings with one minimiser that are counted in memory; a larger group's windows never meet there, but go by a shuffle of their own.
GROUP_BYTES = 48 << 20
#: Below these bytes of packed strings a group's windows are counted as they are.
SMALL_GROUP = 1 << 20
_FIELDS = pa.schema([("mini", pa.int64()), ("packed", pa.binary()), ("rid", pa.binary()), ("start", pa.int32()), ("marked", pa.bool_())])
_DEALT = ["bucket", "blob", "rid", "start", "count", "packed"]
MARKS = "rid binary, start int, count int, packed binary"


def row_id(doc_id: int | None, text: bytes) -> bytes:
    """Equal for repeated rows, whose marks are equal too."""
    return xxhash.xxh3_128_digest(b"%s\0%s" % (str(doc_id).encode(), text))


def leftmost_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the least of each `width` consecutive keys, the leftmost of equals, by doubling."""
    place, have = np.arange(len(keys)), 1
    while have < width:
        step = min(have, width - have)
        place = np.where(keys[step:] < keys[:-step], place[step:], place[:-step])
        keys = np.minimum(keys[:-step], keys[step:])
        have += step
    return place


def super_kmers(codes: np.ndarray, counts: np.ndarray, window: int, mer: int) -> tuple[np.ndarray, ...]:
    """(first window, windows, minimiser) of each super-k-mer, over texts laid end to end; codes are 32-bit word hashes.

    A window's minimiser is its least `mer`-word hash, the leftmost of equals, so equal windows have equal ones at equal
    places, and no two windows of one super-k-mer can be equal.
    """
    n = len(codes)
    if n < window:
        return (np.zeros(0, np.int64),) * 3
    h = np.zeros(n - mer + 1, np.uint64)
    for j in range(mer):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : n - mer + 1 + j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    place = leftmost_least(h, window - mer + 1)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = np.arange(len(place)) + window <= ends[owner[: len(place)]]
    new = inside & np.r_[True, (place[1:] != place[:-1]) | (owner[1 : len(place)] != owner[: len(place) - 1]) | ~inside[:-1]]
    firsts = np.flatnonzero(new)
    upto = np.cumsum(inside)
    sizes = np.diff(np.r_[upto[firsts] - 1, upto[-1] if len(upto) else 0])
    return firsts, sizes, h[place[firsts]].view(np.int64)


def _read(batch: pa.RecordBatch, window: int) -> tuple[list, ...]:
    """(row ids, texts, word offsets, word codes, word counts) of the texts that hold a window."""
    rids, joined, offsets, codes, counts = [], [], [], [], []
    for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
        words = (text or b"").split()
        if len(words) < window:
            continue
        rids.append(row_id(i, text))
        joined.append(b" ".join(words))
        codes.append(np.fromiter(map(crc32, words), np.uint64, len(words)))
        offsets.append(np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        counts.append(len(words))
    return rids, joined, offsets, codes, counts


def _weigh(window: int, mer: int):
    """(mini, bytes): what _pack would send for each minimiser of a step; equal strings, told by a hash of their words, weigh once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=STEP):
            _, _, offsets, codes, counts = _read(batch, window)
            if not counts:
                continue
            codes = np.concatenate(codes)
            firsts, sizes, minis = super_kmers(codes, np.array(counts), window, mer)
            ends = firsts + sizes + window - 1
            before = np.r_[0, np.cumsum(np.concatenate([np.diff(o) for o in offsets]))]
            held = before[ends] - before[firsts] - 1
            odd = 0x9E3779B97F4A7C15
            power, back = (np.cumprod(np.r_[np.uint64(1), np.full(len(codes), x, np.uint64)], dtype=np.uint64) for x in (odd, pow(odd, -1, 1 << 64)))
            total = np.r_[np.uint64(0), np.cumsum((codes + np.uint64(1)) * power[:-1], dtype=np.uint64)]
            same = (total[ends] - total[firsts]) * back[firsts] ^ minis.view(np.uint64)
            once = np.unique(same, return_index=True)[1]
            names, own = np.unique(minis[once], return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(own, held[once]).astype(np.int64))], ["mini", "bytes"])

    return run


def _pack(window: int, mer: int, buckets: int, hot: frozenset[int] = frozenset()):
    """(bucket, blob): the super-k-mers of a step of texts, by bucket; rows without a blob need no counting here.

    Those are marks, and the windows of hot minimisers, which are dealt by a hash of the window. Of equal packed strings
    within the step one goes on, marked: all its places are repeats already, whatever else there is. So a hot passage costs
    its bucket a string for each step and not for each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=STEP):
            rids, joined, offsets, codes, counts = _read(batch, window)
            if not counts:
                continue
            firsts, sizes, minis = super_kmers(np.concatenate(codes), np.array(counts), window, mer)
            before = np.r_[0, np.cumsum(counts)]
            owners = np.searchsorted(before, firsts, side="right") - 1
            starts = firsts - before[owners]
            shift = np.r_[0, np.cumsum([len(o) for o in offsets])]
            flat = np.concatenate(offsets)
            a = flat[shift[owners] + starts].tolist()
            b = (flat[shift[owners] + starts + sizes + window - 1] - 1).tolist()
            owners, starts, sizes, minis = owners.tolist(), starts.tolist(), sizes.tolist(), minis.tolist()
            packed = [joined[o][x:y] for o, x, y in zip(owners, a, b)]
            often = {p for p, c in Counter(packed).items() if c > 1}
            marks, apart, rows = [], [], defaultdict(list)
            for k, p in enumerate(packed):
                if p in often:
                    marks.append((rids[owners[k]], starts[k], sizes[k]))
                elif minis[k] in hot:
                    apart.append((p, rids[owners[k]], starts[k]))
                else:
                    rows[minis[k] % buckets].append((minis[k], p, rids[owners[k]], starts[k], False))
            first = {}
            for k, p in enumerate(packed):
                if p in often:
                    first.setdefault(p, minis[k])
            for p, mini in first.items():
                if mini in hot:
                    apart.append((p, None, 0))
                    continue
                rows[mini % buckets].append((mini, p, b"", 0, True))
            where, blobs = list(rows), []
            for bucket in where:
                part = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[bucket]), _FIELDS)], schema=_FIELDS)
                blobs.append(squeezed(part))
            yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary()), *[pa.nulls(len(where), t) for t in (pa.binary(), pa.int32(), pa.int32(), pa.binary())]], _DEALT)
            if marks:
                r, s, c = zip(*marks)
                yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(x[:4], "big") % buckets for x in r], pa.int32()), pa.nulls(len(r), pa.binary()), pa.array(r, pa.binary()), pa.array(s, pa.int32()), pa.array(c, pa.int32()), pa.nulls(len(r), pa.binary())], _DEALT)
            for at in range(0, len(apart), 500):  # strings whose windows are held together
                r, s, w = zip(*((rid, start + i, w) for p, rid, start in apart[at : at + 500] for i, w in enumerate(windows_of(p, window))))
                yield pa.RecordBatch.from_arrays([pa.array([crc32(x) % buckets for x in w], pa.int32()), pa.nulls(len(r), pa.binary()), pa.array(r, pa.binary()), pa.array(s, pa.int32()), pa.array([1] * len(r), pa.int32()), pa.array(w, pa.binary())], _DEALT)

    return run


def squeezed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def windows_of(packed: bytes, window: int) -> list[bytes]:
    """The windows of a packed string, in order."""
    cuts, at = [0], -1
    while (at := packed.find(b" ", at + 1)) >= 0:
        cuts.append(at + 1)
    cuts.append(len(packed) + 1)
    return [packed[cuts[i] : cuts[i + window] - 1] for i in range(len(cuts) - window)]


def _flags(flags: list[bool], start: int) -> Iterator[tuple[int, int]]:
    """(start, count) of each run of true flags."""
    at = None
    for i, x in enumerate([*flags, False]):
        if x and at is None:
            at = i
        elif not x and at is not None:
            yield start + at, i - at
            at = None


def repeated_windows(strings: Counter, window: int) -> dict[bytes, list[bool]]:
    """For each packed string, which of its windows occur more than once among all, a string counting as often as given. In a large group 128 bits stand for a window, so that it takes some tens of bytes and not its words."""
    names, digests, lengths = list(strings), [], []
    if sum(map(len, names)) < SMALL_GROUP:
        split, counts = {p: windows_of(p, window) for p in names}, Counter()
        for p, n in strings.items():
            for w in split[p]:
                counts[w] += n
        return {p: [counts[w] > 1 for w in own] for p, own in split.items()}
    for p in names:
        own = windows_of(p, window)
        digests.extend(map(xxhash.xxh3_128_digest, own))
        lengths.append(len(own))
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    del digests
    order = np.lexsort((both[:, 1], both[:, 0]))
    new = np.r_[True, (both[order[1:]] != both[order[:-1]]).any(axis=1)]
    weight = np.repeat(np.fromiter(strings.values(), np.int64, len(names)), lengths)[order]
    often = np.empty(len(order), bool)
    often[order] = (np.add.reduceat(weight, np.flatnonzero(new)) > 1)[np.cumsum(new) - 1]
    return {p: flags.tolist() for p, flags in zip(names, np.split(often, np.cumsum(lengths)[:-1]))}


def _count(window: int):
    """Counts the windows of each minimiser in the bucket that a partition's blobs, sorted by bucket, belong to."""

    def of_bucket(blobs: list[bytes]) -> Iterator[tuple]:
        t = pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])
        mini = t.column("mini").to_numpy()
        order = np.argsort(mini, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(mini[order]) != 0, True])
        sizes = np.diff(bounds)
        many = np.flatnonzero(sizes > 1)
        if not len(many):
            return
        rows = np.concatenate([order[bounds[g] : bounds[g + 1]] for g in many])
        part = t.take(pa.array(rows)).combine_chunks()
        packed, rid, start, marked = (part.column(c).to_pylist() for c in ("packed", "rid", "start", "marked"))
        at = 0
        for size in sizes[many].tolist():
            group = range(at, at + size)
            at += size
            strings = Counter()
            for k in group:
                strings[packed[k]] += 1 + marked[k]
            if len(strings) == 1 and sum(strings.values()) < 2:
                continue
            flags = repeated_windows(strings, window)
            for k in group:
                if not marked[k]:
                    for s, c in _flags(flags[packed[k]], start[k]):
                        yield (rid[k], s, c, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            r, s, c, p = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(r, pa.binary()), pa.array(s, pa.int32()), pa.array(c, pa.int32()), pa.array(p, pa.binary())], ["rid", "start", "count", "packed"])

        here, blobs, out = None, [], []
        for batch in batches:
            through = batch.filter(batch.column("blob").is_null())
            if through.num_rows:
                yield pa.RecordBatch.from_arrays([through.column("rid"), through.column("start"), through.column("count"), through.column("packed")], ["rid", "start", "count", "packed"])
            batch = batch.filter(batch.column("blob").is_valid())
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if bucket != here and blobs:
                    for row in of_bucket(blobs):
                        out.append(row)
                        if len(out) >= 20_000:
                            yield batch_of(out)
                            out = []
                    blobs = []
                here = bucket
                blobs.append(blob)
        for row in of_bucket(blobs) if blobs else ():
            out.append(row)
            if len(out) >= 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return run


def repeats(docs: DataFrame, window: int = WINDOW, mer: int = MER, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(rid, start, count): runs of windows, from place `start` of the row's words, that also start anywhere else."""
    own = id_and_text(docs)
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = slots(docs.sparkSession)
    buckets = max(4 * parts, round(3.3 * size / BUCKET_BYTES))  # overlapping strings are about three times the text
    weights = own.mapInArrow(_weigh(window, mer), "mini long, bytes long").groupBy("mini").agg(F.sum("bytes").alias("bytes"))
    hot = frozenset(r.mini for r in weights.where(F.col("bytes") > group_bytes).select("mini").collect())  # at most all packed bytes / group_bytes
    dealt = own.mapInArrow(_pack(window, mer, buckets, hot), "bucket int, blob binary, rid binary, start int, count int, packed binary")
    counted = dealt.repartition(max(parts, buckets // 4), "bucket").sortWithinPartitions("bucket").mapInArrow(_count(window), MARKS)
    counted = written(counted, "counted")
    apart = counted.where("packed IS NOT NULL")
    # a string that was marked before has no row id here, and counts for two
    twice = apart.groupBy("packed").agg(F.sum(F.when(F.col("rid").isNull(), 2).otherwise(1)).alias("n")).where("n > 1").select("packed")
    apart = apart.where("rid IS NOT NULL").join(twice, "packed", "left_semi")
    return counted.where("packed IS NULL").select("rid", "start", "count").unionByName(apart.select("rid", "start", "count"))


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n_words, removed, kept = [], [], []
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
                words = unpack(text).split()
                n = len(words)
                n_words.append(n)
                if marks:
                    edge = np.zeros(n + 1, np.int64)
                    for m in marks:
                        edge[m["start"]] += 1
                        edge[m["start"] + m["count"] + window - 1] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:n]) == 0).tolist()]
                removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the row's id, and packs its text for the way to its marks."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in steps(batches):
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        rids = [row_id(i, t) for i, t in zip(batch.column("doc_id").to_pylist(), texts)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([pack(t) for t in texts], pa.binary()), pa.array(rids, pa.binary())], ["doc_id", "text", "rid"])


def dedup_substrings(docs: DataFrame, window: int = WINDOW, mer: int = MER, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for each row: the words that no repeated window covers, joined by a space, as UTF-8 bytes.

    A window is `window` words of one row; it is repeated if its words start anywhere else as well, in the same text or
    another, a repeated row being another. Null and blank texts have no words; texts shorter than a window lose none; rows
    without a doc_id are treated like any other; other columns of docs stay behind; an empty table gives an empty one.
    """
    marks = repeats(docs, window, mer, group_bytes).groupBy(F.col("rid").alias("mark_rid")).agg(F.collect_set(F.struct("start", "count")).alias("marks"))
    marks = written(marks, "marks")
    rows = id_and_text(docs).mapInArrow(_keyed, "doc_id long, text binary, rid binary")
    # dealt by row id at every size, so that what moves grows with the input
    return rows.join(marks.hint("shuffle_hash"), rows.rid == marks.mark_rid, "left").select("doc_id", "text", "marks").mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept binary")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM texts),
windows AS (
  SELECT rid, pos, word, string_agg(word, ' ') OVER w AS k, count(*) OVER w AS n
  FROM words WINDOW w AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
often AS (SELECT k FROM windows WHERE n = 35 GROUP BY k HAVING count(*) > 1),
starts AS (SELECT a.rid, a.pos, a.word, CAST(a.n = 35 AND b.k IS NOT NULL AS INT) AS repeated FROM windows a LEFT JOIN often b ON a.k = b.k),
judged AS (SELECT *, max(repeated) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM starts)
SELECT any_value(t.doc_id) AS doc_id, count(j.pos) AS n_words, count(*) FILTER (gone = 1) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0), '')) AS kept_sha256
FROM texts t LEFT JOIN judged j USING (rid) GROUP BY t.rid
"""

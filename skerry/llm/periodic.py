"""Periodic runs of words: blocks of dyadic lengths are found again in the windows behind them by exact integer convolution.

At scale L, of each 2 L words the first L are a block. Against the window that follows, the sums of squared differences of word codes at
all distances L to 2 L - 1 come from one number-theoretic transform; a sum of zero is an occurrence. A run whose period q lies
in that range has 4 q words at least, so some block lies in it with its copy q words on: no run is missed. Distances are then
extended both ways to maximal stretches, on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession, functions as F
from zlib import crc32

from .common import numbered, steps, table, unused
from .quality import word_codes

#: A run has this many words, and this many periods, at least. The search relies on four periods.
MIN_WORDS, MIN_PERIODS = 6, 4
#: The Fermat prime 2 ** 16 + 1 and a generator: transforms of any power of two up to 2 ** 16.
PRIME, GENERATOR = 65_537, 3
#: Words of the longest block; longer periods use blocks of this length and several windows.
MAX_BLOCK = 1 << 15
#: Transforms up to this length are one matrix product, longer ones two.
DIRECT = 64
#: Words that are transformed together.
_CHUNK = 1 << 18
#: Primes of the hashes that propose how far a stretch goes.
_PRIMES = (2_147_483_647, 2_147_483_629)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME in 0 .. PRIME, exact for whole numbers below 2 ** 52; zero may come as PRIME."""
    return x - PRIME * np.floor(x * (1 / PRIME))


@lru_cache(maxsize=None)
def _powers(n: int, rows: int, columns: int, sign: int) -> np.ndarray:
    """w ** (sign i j) for i < rows, j < columns, w an n-th root of unity. Products of these and numbers up to PRIME, 256 added up, stay below 2 ** 41, so floats hold them exactly."""
    w = pow(GENERATOR, (PRIME - 1) // n * sign % (PRIME - 1), PRIME)
    power = np.ones(n)
    for i in range(1, n):
        power[i] = power[i - 1] * w % PRIME
    return power[np.outer(np.arange(rows), np.arange(columns)) % n]


def transform(x: np.ndarray, sign: int = 1) -> np.ndarray:
    """The number-theoretic transform of each row; sign -1 is the inverse, but for the factor of the length."""
    m, n = x.shape
    if n <= DIRECT:
        return _mod(x @ _powers(n, n, n, sign))
    a = 1 << n.bit_length() // 2
    b = n // a
    y = _mod(_powers(a, a, a, sign) @ x.reshape(m, a, b))
    y = _mod(_mod(y * _powers(n, a, b, sign)) @ _powers(b, b, b, sign))
    return y.transpose(0, 2, 1).reshape(m, n)


def _bits(block: int) -> int:
    """Bits of a code such that a block's sum of squared differences is below PRIME, and so is zero if and only if it is zero modulo PRIME."""
    return max(w for w in range(1, 9) if block * (2**w - 1) ** 2 < PRIME)


def occurrences(codes: np.ndarray, starts: np.ndarray, block: int, ahead: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance): where the block at a start occurs again, at distances ahead .. ahead + block - 1. codes: 64-bit hashes of words, of which the upper bits are compared, with room for 3 blocks behind."""
    shift = np.uint64(64 - _bits(block))
    own = np.zeros((len(starts), 2 * block))
    own[:, :block] = sliding_window_view(codes, block)[starts] >> shift
    window = (sliding_window_view(codes, 2 * block)[starts + ahead] >> shift).astype(float)
    cross = transform(_mod(transform(window) * transform(own, -1)), -1)[:, :block]
    squares = np.zeros((len(starts), 2 * block + 1))
    np.cumsum(window * window, axis=1, out=squares[:, 1:])
    both = (squares[:, block : 2 * block] - squares[:, :block]) + (own * own).sum(axis=1, keepdims=True)
    at, distance = np.nonzero(_mod(2 * block * both + 2 * (PRIME - cross)) % PRIME == 0)
    return starts[at], ahead + distance


class Stretches:
    """How far words stay equal to those a distance on, by hashes of prefixes; what is proposed is checked on the words."""

    def __init__(self, codes: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.sums, self.powers = [], []
        for prime in _PRIMES:
            p = np.uint64(prime)
            base, power = int(rng.integers(1 << 20, prime - 1)), np.ones(1, np.uint64)
            while len(power) <= len(codes):
                power = np.r_[power, power * np.uint64(pow(base, len(power), prime)) % p]
            self.powers.append(power)
            self.sums.append(np.r_[np.uint64(0), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)] % p) % p])

    def equal(self, a: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether the m words from a and from b > a are the same."""
        out = np.ones(len(a), bool)
        for prime, s, power in zip(_PRIMES, self.sums, self.powers):
            p = np.uint64(prime)
            out &= (s[a + m] + p - s[a]) % p * power[b - a] % p == (s[b + m] + p - s[b]) % p
        return out

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """Words, at most `most`, that are equal from a and b on, or before them."""
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            m = (low + high + 1) // 2
            same = self.equal(a - m, b - m, m) if back else self.equal(a, b, m)
            low, high = np.where(same, m, low), np.where(same, high, m - 1)
        return low


def _proposed(codes: np.ndarray, counts: np.ndarray, seed: int) -> np.ndarray:
    """Rows (start, length, period) over texts laid end to end, sorted; a stretch has its least period."""
    n, ends = len(codes), np.cumsum(counts)
    begin, end = np.repeat(ends - counts, counts), np.repeat(ends, counts)
    size = end - begin
    mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = np.r_[mixed ^ (mixed >> np.uint64(32)), np.zeros(3 * min(MAX_BLOCK, n), np.uint64)]
    found, stretches, scale = [np.zeros((0, 3), np.int64)], None, 1
    covered = np.zeros(n, np.int64)  # by start: how far runs of lower scales go that begin there or before
    while MIN_PERIODS * scale <= counts.max(initial=0):
        if scale <= MAX_BLOCK:
            start, length, _ = np.concatenate(found).T
            np.maximum.at(covered, start, start + length)
            covered = np.maximum.accumulate(covered)
        block = min(scale, MAX_BLOCK)
        starts = np.arange(0, n - 2 * scale + 1, 2 * scale)
        starts = starts[(size[starts] >= MIN_PERIODS * scale) & (starts + 2 * scale <= end[starts])]
        together = max(1, _CHUNK // (2 * block))
        for at in range(0, len(starts), together):
            for ahead in range(scale, 2 * scale, block):
                s, d = occurrences(mixed, starts[at : at + together], block, ahead)
                # what lies in a run of shorter period has that period's multiples as distances: the same run again
                inside = (s + d + block <= end[s]) & (s + d + block > covered[s])
                s, d = s[inside], d[inside]
                if not len(s):
                    continue
                stretches = stretches or Stretches(codes, seed)
                right = stretches.reach(s, s + d, end[s] - s - d)
                start = s - stretches.reach(s, s + d, s - begin[s], back=True)
                length = s + d + right - start
                long_ = (length >= np.maximum(MIN_WORDS, MIN_PERIODS * d)) & (right >= block)
                found.append(np.unique(np.stack([start, length, d], axis=1)[long_], axis=0))
        scale *= 2
    every = np.unique(np.concatenate(found), axis=0)
    least = np.r_[True, (every[1:, :2] != every[:-1, :2]).any(axis=1)] if len(every) else np.zeros(0, bool)
    every = every[least]
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def runs_of(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All runs (start, length, period) of texts laid end to end, by start and period; codes are equal for equal words. Proposals that do not hold on the words are made again with other hashes."""
    for seed in count():
        runs = _proposed(codes, counts, seed)
        if all((codes[s : s + k - q] == codes[s + q : s + k]).all() for s, k, q in runs.tolist()):
            return runs


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches):
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        codes, counts = word_codes(texts)
        runs = runs_of(codes, counts)
        ends = np.cumsum(counts)
        start, length, period = runs.T
        edge = np.bincount(start + period, minlength=len(codes) + 1) - np.bincount(start + length, minlength=len(codes) + 1)
        gone = np.cumsum(edge)[:-1] > 0
        owner = np.searchsorted(ends, start, side="right")
        some = set(owner.tolist())
        kept = []
        for i, t in enumerate(texts):
            words = t.split()
            if i in some:
                words = [words[k] for k in np.flatnonzero(~gone[ends[i] - counts[i] : ends[i]]).tolist()]
            kept.append(b" ".join(words))
        offsets = pa.array(np.r_[0, np.cumsum(np.bincount(owner, minlength=len(texts)))], pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - (ends - counts)[owner], length, period)], ["start", "length", "period"]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64()), lists, pa.array(kept, pa.binary())], [*batch.schema.names, "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """docs with the columns __n_words, __runs (start, length, period in words, by start and period) and __collapsed (bytes).

    A run is a stretch of words with least period q, of 4 q words and 6 words at least, that no neighbour extends. The
    collapsed text is its words, joined by a space, without those that any run holds after its first period. One pass, no
    shuffle: a text is searched by itself, whatever its length. Null and blank texts have no words, no runs and collapse to
    an empty text; repeated rows give equal rows; all columns stay, whatever their names (a new name that is taken gets more
    underscores); an empty table stays empty.
    """
    plain, columns = numbered(docs)
    text = columns["text"]
    rest = [c for c in columns.values() if c != text]
    kinds = [f"{c} {plain.schema[c].dataType.simpleString()}" for c in rest] + ["text binary, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary"]
    out = plain.select(*rest, F.col(text).cast("binary").alias("text")).mapInArrow(_runs, ", ".join(kinds))
    out = out.withColumn(text, F.col("text").cast(plain.schema[text].dataType))
    new = ("n_words", "runs", "collapsed")
    return out.select(*columns.values(), *new).toDF(*docs.columns, *unused(docs.columns, *[f"__{k}" for k in new]))


def _stretched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The query's texts: a tenth of the documents, by a hash of doc_id, end in a period of words of their own."""
    for batch in steps(batches):
        out = []
        for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            h = crc32(str(i).encode())
            words = (text or b"").split() if i is not None and h % 10 == 0 else ()
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                text = b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)])
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "text"])


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = periodic_runs(docs.mapInArrow(_stretched, "doc_id long, text binary"))
    longest = F.array_min(F.transform("__runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("__runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("__runs").cast("long").alias("n_runs"), longest.alias("r"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("__collapsed", 256).alias("collapsed_sha256"))
    length = -F.col("r.less")
    return out.select("doc_id", "n_runs", F.col("r.start").alias("start"), length.alias("length"), F.col("r.period").alias("period"), F.floor(1000 * length / F.col("r.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

"""Best-fit packing: each partition is packed best-fit decreasing and certified by a lower bound; the rest exchange documents and pack again."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import WHITE, id_and_text, steps, table, written

CAPACITY = 4096
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Pieces that a partition packs at once, and rounds of exchange at most.
ITEMS = 20_000
ROUNDS = 6
#: Bytes of text whose words are held at once; a longer text is cut between words.
SEGMENT = 4 << 20
#: Pieces that are kept from one segment to the next, in each of two generations.
PIECES = 100_000
#: What cuts a text into pieces, in the tokenizer's own file; runs of the characters below are cut by the kinds of bytes instead.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Finds runs with an apostrophe, a special token, or a character that lower-casing or composition treats in a way of its own.
ODD = r"[^!-&(-~À-ÖØ-öø-įı-ňŊ-ž]|<\|"
#: Letters (every byte of a longer character is of a letter here), digits and signs.
_KINDS = np.array([0 if b > 127 or chr(b).isalpha() else 1 if chr(b).isdigit() else 2 for b in range(256)], np.uint8)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ragged(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of the rows asked for; row i of the input is values[offsets[i] : offsets[i + 1]]."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    return values[np.repeat(offsets[rows] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], np.r_[0, ends]


def segments(text: bytes, most: int = SEGMENT) -> Iterator[bytes]:
    """The text in slices of at most `most` bytes, cut at white space; only a longer run without any makes a longer slice."""
    at = 0
    while len(text) - at > most:
        cut = max(text.rfind(bytes([c]), at + 1, at + most) for c in WHITE)
        if cut < 0:
            cut = min((k for c in WHITE if (k := text.find(bytes([c]), at + most)) >= 0), default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


@lru_cache(maxsize=1)
def loaded(path: str):
    """(tokenizer, the same for pieces that are cut and folded already, or None where its file does not cut by PATTERN, which tokens end a piece)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    parts = json.loads(tokenizer.to_str())
    first, *rest = (parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    bare = None
    if first.get("pattern") == {"Regex": PATTERN}:
        parts |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}}
        bare = Tokenizer.from_str(json.dumps(parts))
    closes = np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab().items():
        closes[i] = token.endswith("</w>")
    return tokenizer, bare, closes


def as_text(values: list[bytes]) -> pa.Array:
    """The values as strings; what is no UTF-8 is replaced."""
    raw = pa.array(values, pa.binary())
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([v.decode("utf-8", "replace") for v in values], pa.string())


class Encoder:
    """Ids of a tokenizer that drops white space and lower-cases, many texts at once.

    White space ends every piece that its model sees, so runs between it are independent: each distinct run of a segment
    is cut once, and each distinct piece of these goes through the model once. Odd runs go through it whole. Pieces
    that come more than once are kept for the next segment, in two generations of bounded size: the older one is
    dropped when the younger is full. An encoder, and what it keeps, ends with its task.
    """

    def __init__(self, path: str, most: int = PIECES) -> None:
        self.tokenizer, self.bare, self.closes = loaded(path)
        self.most, self.young, self.old = most, {}, {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pieces, a few hundred of them in one text; a piece is ended by its last id alone."""
        groups = [b" ".join(pieces[i : i + 200]).decode() for i in range(0, len(pieces), 200)]
        out = []
        for e in self.bare.encode_batch_fast(groups, add_special_tokens=False) if groups else ():
            ids = np.array(e.ids, np.uint32)
            ends, raw = (4 * np.flatnonzero(self.closes[ids]) + 4).tolist(), ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def pieces(self, names: pa.Array, often: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct pieces; those that come often are kept."""
        keys, young, old = names.to_pylist(), self.young, self.old
        found = [young.get(k) or old.get(k) for k in keys]
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self._new([keys[i] for i in missing])):
            found[i] = ids
        for i in np.flatnonzero(often).tolist():
            young[keys[i]] = found[i]
            if len(young) >= self.most:
                self.old, young = young, {}
        self.young = young
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), np.uint32), np.r_[0, np.cumsum(sizes)]

    def runs(self, runs: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct runs without white space, each of which comes counts times."""
        odd = np.ones(len(runs), bool)
        if self.bare:
            odd = pc.match_substring_regex(runs, ODD).to_numpy(zero_copy_only=False)
        plain = pc.utf8_lower(runs.filter(pa.array(~odd)))
        at = np.flatnonzero(~odd)
        ends = np.frombuffer(plain.buffers()[1], np.int32)[plain.offset : plain.offset + len(plain) + 1].astype(np.int64) if len(plain) else np.zeros(1, np.int64)
        raw = np.frombuffer(plain.buffers()[2], np.uint8)[: ends[-1]] if ends[-1] else np.zeros(0, np.uint8)
        kinds = _KINDS[raw]
        new = np.ones(len(raw), bool)
        new[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == 1)
        new[ends[:-1][np.diff(ends) > 0]] = True
        starts = np.flatnonzero(new)
        cut = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(raw)].astype(np.int32)), pa.py_buffer(raw)]).dictionary_encode()
        codes = cut.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        own = np.searchsorted(ends, starts, side="right") - 1
        ids, offsets = self.pieces(cut.dictionary, np.bincount(codes, counts[at][own], len(cut.dictionary)) > 1)
        flat, bounds = ragged(ids, offsets, codes)
        sizes = np.zeros(len(runs), np.int64)
        sizes[at] = np.bincount(own, np.diff(bounds), len(at)).astype(np.int64)
        if not odd.any():
            return flat, np.r_[0, np.cumsum(sizes)]
        alone = self._whole(runs.filter(pa.array(odd)).to_pylist())
        sizes[odd] = [len(x) for x in alone]
        # plain runs first, odd ones behind them, and then all in their order
        order = np.r_[at, np.flatnonzero(odd)]
        place = np.empty(len(runs), np.int64)
        place[order] = np.arange(len(runs))
        return ragged(np.concatenate([flat, *alone]), np.r_[0, np.cumsum(sizes[order])], place)

    def _held(self, texts: list[bytes]) -> list[np.ndarray]:
        text = as_text(texts)
        special = pc.match_substring(text, "<|")  # a special token's own string must keep its case
        text = pc.if_else(special, text, pc.ascii_lower(text)) if pc.any(special).as_py() else pc.ascii_lower(text)
        split = pc.ascii_split_whitespace(text)
        coded = split.flatten().dictionary_encode()
        where = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, bounds = ragged(*self.runs(coded.dictionary, np.bincount(where, minlength=len(coded.dictionary))), where)
        ends = bounds[np.r_[0, np.cumsum(split.value_lengths().to_numpy())]]
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text, without an end mark."""
        if sum(map(len, texts)) <= SEGMENT:
            return self._held(texts)
        return [np.concatenate([self._held([part])[0] for part in segments(t)]) for t in texts]


def _pieces(path: str | None, capacity: int):
    """(doc_id, piece, start, length, ids_crc32) of each piece of at most `capacity` ids, the end mark included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path or tokenizer_path()), np.array([END], "<u4")
        for batch in steps(batches, most=SEGMENT):
            rows = []
            for i, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode([t or b"" for t in batch.column("text").to_pylist()])):
                ids = np.append(ids, end).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((i, k, at, len(part), crc32(part.tobytes())))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def tokenized(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of whole documents. path: the tokenizer's file, the same on all machines; None: each machine's own copy."""
    return id_and_text(docs).mapInArrow(_pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: the best of dual feasible functions u(k) and of plain volume.

    u(k)(x) is x where (k + 1) * x / capacity is whole and floor((k + 1) * x / capacity) * capacity / k else; f(t) counts items
    over capacity - t as whole bins and leaves out those under t. A dual feasible function maps any full bin to a volume of at
    most one bin, so the mapped volume bounds the bins.
    """
    return bound_of_counts(np.bincount(lengths, minlength=capacity + 1), capacity)


def bound_of_counts(counts: np.ndarray, capacity: int) -> int:
    """lower_bound, from the number of items of each length from 0 to the capacity."""
    x = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((counts * x).sum()) // capacity)
    for k in range(1, 21):
        y = (k + 1) * x
        # scaled by k to stay whole
        u = np.where(y % capacity == 0, x * k, y // capacity * capacity)
        best = max(best, -(-int((counts * u).sum()) // (capacity * k)))
    items, volume = np.r_[0, np.cumsum(counts)], np.r_[0, np.cumsum(counts * x)]
    t = np.arange(1, capacity // 2 + 1)
    whole = items[-1] - items[capacity - t + 1]
    middle = volume[capacity - t + 1] - volume[t]
    return max(best, int((whole + -(-middle // capacity)).max()))


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item: the longest first, each into the fullest bin that holds it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, bins = 0, np.empty(len(lengths), np.int64)
    left: list[int] = []
    offsets = np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fits := open_ >> n:
            space = n + (fits & -fits).bit_length() - 1
            b = room[space].pop()
            if not room[space]:
                open_ &= ~(1 << space)
        else:
            b, space = len(left), capacity
            left.append(capacity)
        bins[i], offsets[i] = b, capacity - space
        space -= n
        left[b] = space
        if space:
            room[space].append(b)
            open_ |= 1 << space
    return bins, offsets


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, uid long, sequence_id long, offset long, settled boolean"


def _pack(capacity: int, turn: int, last: bool):
    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by("uid")
        lengths = part.column("length").to_numpy()
        bins, offsets = best_fit_decreasing(lengths, capacity)
        used = int(bins.max()) + 1
        settled = np.full(len(lengths), last or used == lower_bound(lengths, capacity))
        if not settled[0]:  # full bins lose nothing by staying as they are
            settled = np.bincount(bins, lengths, used)[bins] == capacity
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "uid"]
        ids = (turn << 56) + (key[0].as_py() << 28) + bins
        return pa.table([*[part.column(n) for n in names], pa.array(ids), pa.array(offsets), pa.array(settled)], names=[*names, "sequence_id", "offset", "settled"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, items: int = ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """pieces with sequence_id and offset; none is longer than the capacity.

    Pieces as long as the capacity are sequences by themselves. The others are dealt over partitions of about `items`
    pieces, packed and certified: a partition with as many bins as its lower bound is settled, and so is every full bin.
    What is left in partitions with a gap is dealt anew, over fewer partitions, and packed again, until nothing is left,
    one partition has taken all that is left, or the rounds are over: `certificate` tells what gap is left then.
    """
    spark = pieces.sparkSession
    pieces = written(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    whole = F.col("length") == capacity
    done = [pieces.where(whole).withColumn("sequence_id", -1 - F.col("uid")).withColumn("offset", F.lit(0).cast("long"))]
    todo = pieces.where(~whole)
    for turn in range(rounds):
        left = todo.count()
        if not left:
            break
        parts = -(-left // items)
        last = parts == 1 or turn == rounds - 1
        dealt = todo.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(turn)), F.lit(parts)))
        placed = written(dealt.groupBy("part").applyInArrow(_pack(capacity, turn, last), PLACED), "placed")
        done.append(placed.where("settled").drop("settled"))
        todo = placed.where("NOT settled").drop("settled", "sequence_id", "offset")
        if last:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("uid")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, sequences that any packing needs at least); equal, where no better packing exists. The driver gets a row for each length."""
    used = packed.select("sequence_id").distinct().count()
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():
        counts[length] = n
    return used, bound_of_counts(counts, capacity)


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its text's ids and one end mark; only longer ones are cut. A null text is empty: the mark alone. Rows
    without a doc_id and repeated rows are packed like any other; other columns stay behind; an empty table gives none.
    """
    return pack(tokenized(docs, path, capacity), capacity)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))



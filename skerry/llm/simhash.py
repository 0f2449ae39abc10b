"""SimHash near-duplicates: 64-bit majority fingerprints, linked by BK-trees on shards that share half their bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import LOWER, id_and_text, slots, steps, table, written
from .components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Fingerprints that one tree holds; a larger shard is dealt over several trees, each asked by the whole shard.
TREE = 20_000
_CHUNK = 1 << 15


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """Bits that are set in over half of the XXH64 hashes of the shingles, repeats included; 0 without a word."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words)
    width = min(shingle, n)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1, out=starts[1:])
    first, last = starts[: n - width + 1].tolist(), (starts[width:] - 1).tolist()
    hash64 = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), _CHUNK):
        hashes = np.array([hash64(joined[a:b], SEED) for a, b in zip(first[at : at + _CHUNK], last[at : at + _CHUNK])], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(first)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a long. A null or blank text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            fps = [_signed(fingerprint(t, shingle)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Integers under Hamming distance: a node's children are keyed by their distance to it. Items within the radius of each other share a root."""

    def __init__(self, radius: int) -> None:
        self.radius, self.items, self.children, self.parent = radius, [], [], []

    def near(self, item: int) -> list[int]:
        """Places of the items within the radius; only edges whose key can lead there are followed."""
        if not self.items:
            return []
        found, todo, r, items, children = [], [0], self.radius, self.items, self.children
        while todo:
            at = todo.pop()
            d = (items[at] ^ item).bit_count()
            if d <= r:
                found.append(at)
            edges = children[at]
            if edges:
                if len(edges) <= 2 * r + 1:
                    todo += [child for key, child in edges.items() if -r <= key - d <= r]
                else:
                    todo += [edges[key] for key in range(d - r, d + r + 1) if key in edges]
        return found

    def root(self, at: int) -> int:
        parent = self.parent
        while parent[at] != at:
            parent[at] = at = parent[parent[at]]
        return at

    def put(self, item: int) -> int:
        """The item's place; one that is there already keeps its own."""
        own = len(self.items)
        if own:
            at = 0
            while d := (self.items[at] ^ item).bit_count():
                if d not in self.children[at]:
                    self.children[at][d] = own
                    break
                at = self.children[at][d]
            else:
                return at
        self.items.append(item)
        self.children.append({})
        self.parent.append(own)
        return own

    def add(self, item: int) -> None:
        links = self.near(item)
        own = self.put(item)
        for x in links:
            a, b = self.root(x), self.root(own)
            self.parent[max(a, b)] = min(a, b)


def _link(radius: int):
    """Rows come sorted by shard and block, a block's own members before the rest of its shard: grow the tree, then ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree, out_a, out_b = None, BKTree(radius), [], []

        def close() -> None:
            for at, item in enumerate(tree.items):
                if (r := tree.root(at)) != at:
                    out_a.append(_signed(item))
                    out_b.append(_signed(tree.items[r]))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("way", "shard", "block", "asks", "fp")]
            for way, shard, block, asks, fp in zip(*columns):
                fp &= (1 << 64) - 1
                if (way, shard, block) != here:
                    close()
                    here, tree = (way, shard, block), BKTree(radius)
                if not asks:
                    tree.add(fp)
                else:
                    for r in {tree.root(x) for x in tree.near(fp)}:
                        out_a.append(_signed(fp))
                        out_b.append(_signed(tree.items[r]))
            if len(out_a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
                out_a, out_b = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def ways(bits: list[int], radius: int) -> list[int]:
    """Masks of the bits such that two items within the radius agree under one of them at least: two of radius + 2 equal parts each."""
    edges = [len(bits) * i // (radius + 2) for i in range(radius + 3)]
    parts = [sum(1 << b for b in bits[low:high]) for low, high in zip(edges, edges[1:])]
    return [_signed(a | b) for a, b in combinations(parts, 2)]


def links(fps: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(a, b) such that the links reach exactly the pairs of distinct fingerprints within the radius, and their like.

    Fingerprints that differ in `radius` bits agree in two of `radius + 2` equal parts: each pair of parts makes a way to
    shard, and a shard's tree is looked up by its own shard alone. A shard of over `tree` items is cut once more, in as many
    ways of its other bits. What is left has few free bits (16 of 64 for a radius of 2, so 65,536 items at most); over
    `tree` items are dealt over several trees, each asked by all of them. A tree gives a link to the root of what it has
    found, so a dense group costs a link for each member and not for each pair.
    """
    masks = ways(list(range(64)), radius)
    free = [[b for b in range(64) if not (m >> b) & 1] for m in masks]
    further = [[_signed((m | n) & ((1 << 64) - 1)) for n in ways(bits, radius)] for m, bits in zip(masks, free)]

    def sharded(items: DataFrame) -> DataFrame:
        """Items (way, mask, fp) with the size of their shard; those alone in one are left out."""
        items = items.withColumn("shard", F.col("fp").bitwiseAND(F.col("mask"))).drop("mask")
        return items.join(items.groupBy("way", "shard").agg(F.count("*").alias("size")).where("size > 1"), ["way", "shard"])

    def each(options: Column) -> Column:
        return F.posexplode(options).alias("k", "mask")

    whole = sharded(fps.select("fp", each(F.array(*map(F.lit, masks)))).withColumnRenamed("k", "way"))
    own = F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in further]), F.col("way") + 1)
    cut = whole.where(F.col("size") > tree).select("way", "fp", each(own))
    cut = sharded(cut.select((F.col("way") * len(further[0]) + F.col("k") + len(masks)).alias("way"), "mask", "fp"))
    dealt = whole.where(F.col("size") <= tree).unionByName(cut).withColumn("blocks", F.ceil(F.col("size") / tree).cast("long"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("asks", F.col("block") != block)
    dealt = dealt.select("way", "shard", "block", "asks", "fp")
    n = slots(fps.sparkSession)
    return dealt.repartition(n, "way", "shard", "block").sortWithinPartitions("way", "shard", "block", "asks", "fp").mapInArrow(_link(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach).

    Null and blank texts have fingerprint 0 and link like any other. A null doc_id is no candidate for component_id, which
    is null only where a whole component has no doc_id. Repeated rows stay; an empty table gives none; other columns go.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    reached = components(links(distinct.select("fp"), radius))
    joined = distinct.join(reached, distinct.fp == reached.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = joined.join(named, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""SimHash near-duplicates at a similarity of word shingles: BK-trees on shards propose pairs, exact Jaccard decides, components follow.

Texts at a Jaccard similarity of 0.8 differ in some 10 of 64 fingerprint bits, too many to shard by the bits themselves. The
shards are therefore named by least hashes of the shingles, of which similar texts share some; inside, the trees are simhash's.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, numbered, scratch, shared_folder, slots, steps, until_exit, written
from .components import components
from .simhash import TREE, BKTree

SHINGLE = 5
SIMILAR = 0.8
#: Minima that name a shard, and shards of a text: a pair at 0.8 shares none with probability (1 - 0.8 ** 4) ** 20, about 3 in 100,000.
ROWS, BANDS = 4, 20
#: Bits of the fingerprints of a pair that is looked at; at 0.8 they are 9.7, give or take 2.9, and a few more for very short texts.
RADIUS = 22
#: Equal minima, of 80, below which a pair's texts are not read; at 0.8 they are 64, give or take 3.6.
LIKELY = 46
#: Candidates of an item that are looked at one by one; of more, shared shingles are counted first.
FEW = 32
#: Items and bytes of text that are held in one tree with their texts.
TREE_TEXTS, TREE_BYTES = 4_000, 16 << 20
#: Members that are held against one copy of a hub's text.
MEMBERS = 256
_STEP = 1 << 20
_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, ROWS * BANDS, np.uint64)


def shingles(text: bytes | None, size: int = SHINGLE) -> set[bytes]:
    """Runs of `size` words in lower case; a shorter text is one shingle, and so is a text without words."""
    words = (text or b"").translate(LOWER).split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """A number for each shingle of the text, repeats included: equal for equal shingles, and hardly ever else."""
    words = (text or b"").translate(LOWER).split()
    codes = np.fromiter(map(crc32, words), np.uint64, len(words)) if words else np.zeros(1, np.uint64)
    width = min(size, len(codes))
    h = np.zeros(len(codes) - width + 1, np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[j : len(codes) - width + 1 + j] + np.uint64(1)
    return _mix(h)


def sketches(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Texts x (ROWS * BANDS), the least value of each hash over a text's shingles; and fingerprints: bits that over half of its shingles' hashes set."""
    hashes = [shingle_hashes(t, size) for t in texts]
    sizes = np.array([len(h) for h in hashes])
    h = np.concatenate(hashes)
    starts = np.cumsum(sizes) - sizes
    least = np.stack([np.minimum.reduceat(_mix(h ^ s) * f, starts) for f, s in zip(_FACTORS, _SHIFTS)], axis=1)
    fps = np.zeros(len(texts), np.uint64)
    h = _mix(h * np.uint64(0x9E3779B97F4A7C15))
    for k in range(64):
        over = 2 * np.add.reduceat((h >> np.uint64(k)) & np.uint64(1), starts) > sizes
        fps |= over.astype(np.uint64) << np.uint64(k)
    return least, fps


def _sketch(size: int):
    """(id, bands, sig, fp, bytes): a hash for each shard, a byte of each minimum, the fingerprint, and the length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, most=_STEP):
            least, fps = sketches(batch.column("text").to_pylist(), size)
            bands = np.zeros((len(least), BANDS), np.uint64) + np.arange(BANDS, dtype=np.uint64)
            for j in range(ROWS):
                bands = _mix(bands * np.uint64(0x9E3779B97F4A7C15) + least[:, j::ROWS])
            sig = np.ascontiguousarray((_mix(least) >> np.uint64(56)).astype(np.uint8))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(fps.view(np.int64)), pa.compute.binary_length(batch.column("text")).cast(pa.int64())], ["id", "bands", "sig", "fp", "bytes"])

    return run


def _center(fps: list[int]) -> int:
    """Place of the fingerprint that is nearest to the majority of all in every bit."""
    bits = np.unpackbits(np.array(fps, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int((bits != (2 * bits.sum(axis=0) > len(fps))).sum(axis=1).argmin())


def _stars(radius: int):
    """Pairs (a, b) of ids, from rows sorted by shard: an item near no leader in the tree becomes one, and a leader's followers are paired with the most central of them.

    Copies of one text differ less from it than from each other, and it is what their bits have in common; so most of m
    near copies are linked by m pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, tree, groups, out_a, out_b = None, BKTree(radius), [], [], []

        def close() -> None:
            for ids, fps in groups:
                if len(ids) > 1:
                    out_a.extend(ids)
                    out_b.extend([ids[_center(fps)]] * len(ids))

        for batch in batches:
            for bucket, block, i, fp in zip(*[batch.column(c).to_pylist() for c in ("bucket", "block", "id", "fp")]):
                if (bucket, block) != here:
                    close()
                    here, tree, groups = (bucket, block), BKTree(radius), []
                fp &= (1 << 64) - 1
                near = tree.near(fp)
                if not near:
                    tree.put(fp)
                    groups.append(([], []))
                ids, fps = groups[near[0] if near else -1]
                ids.append(i)
                fps.append(fp)
            if len(out_a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
                out_a, out_b = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def alike(x: set[bytes], y: set[bytes], similar: float) -> bool:
    if min(len(x), len(y)) < similar * max(len(x), len(y)):
        return False
    both = len(x & y)
    return both >= similar * (len(x) + len(y) - both)


class Shard:
    """The items of one tree: ids, components and texts by place, and where each shingle's hash occurs."""

    def __init__(self, radius: int, size: int, similar: float) -> None:
        self.tree, self.size, self.similar = BKTree(radius), size, similar
        self.at, self.items, self.parent, self.index = [], [], {}, None

    def put(self, fp: int, i: int, component: int, text: bytes) -> None:
        place = self.tree.put(fp)
        if place == len(self.at):
            self.at.append([])
        self.at[place].append(len(self.items))
        self.items.append((i, component, text))

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.get(x, x)) != x:
            parent[x] = x = parent.get(up, up)
        return x

    def _sharing(self, text: bytes) -> np.ndarray:
        """Which items share enough of the text's shingles, by their hashes: counted for all items at once."""
        if self.index is None:
            hashes = [np.unique(shingle_hashes(t, self.size)) for _, _, t in self.items]
            sizes = np.array([len(h) for h in hashes])
            flat = np.concatenate(hashes)
            order = np.argsort(flat, kind="stable")
            self.index = flat[order], np.repeat(np.arange(len(sizes)), sizes)[order], sizes
        flat, owners, sizes = self.index
        own = np.unique(shingle_hashes(text, self.size))
        low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
        n = high - low
        ends = np.cumsum(n)
        both = np.bincount(owners[np.repeat(high - ends, n) + np.arange(ends[-1])], minlength=len(sizes))
        return both >= self.similar * (len(own) + sizes - both) - 1e-6

    def links(self, fp: int, i: int, component: int, text: bytes) -> list[int]:
        """Ids of other components' items that are similar to the text, one for each component that it is not linked to yet."""
        near = [k for x in self.tree.near(fp) for k in self.at[x] if self.root(self.items[k][1]) != self.root(component)]
        if len(near) > FEW:
            enough = self._sharing(text)
            near = [k for k in near if enough[k]]
        out, own = [], None
        for k in near:
            j, other, theirs = self.items[k]
            if self.root(other) == self.root(component):
                continue
            own = own or shingles(text, self.size)
            if alike(own, shingles(theirs, self.size), self.similar):
                self.parent[self.root(other)] = self.root(component)
                out.append(j)
        return out


def _across(radius: int, size: int, similar: float):
    """Links (a, b) between components, from rows sorted by shard, those that build the tree before those that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, shard = None, None
        for batch in steps(batches):
            out = []
            for bucket, block, asks, component, i, fp, text in zip(*[batch.column(c).to_pylist() for c in ("bucket", "block", "asks", "component", "id", "fp", "text")]):
                if (bucket, block) != here:
                    here, shard = (bucket, block), Shard(radius, size, similar)
                fp &= (1 << 64) - 1
                if asks:
                    out += [(i, j) for j in shard.links(fp, i, component, text)]
                else:
                    shard.put(fp, i, component, text)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def stars(members: DataFrame, radius: int = RADIUS, tree: int = TREE) -> DataFrame:
    """(a, b), a > b, of members (bucket, size, id, fp): near pairs around the middle of each group. A shard over `tree` is dealt over several trees."""
    block = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / tree).cast("long"))
    dealt = members.select("bucket", block.alias("block"), "id", "fp").repartition(slots(members.sparkSession), "bucket", "block").sortWithinPartitions("bucket", "block", "id")
    found = dealt.mapInArrow(_stars(radius), "a long, b long")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")


def across(members: DataFrame, labels: DataFrame, texts: DataFrame, size: int, similar: float, radius: int = RADIUS, tree: int = TREE_TEXTS, tree_bytes: int = TREE_BYTES) -> DataFrame:
    """(a, b): similar pairs that link the components of members (bucket, size, bytes, id, fp), by labels (id, component).

    Of two items of different components one is outside its shard's largest component at least: these ask, and all others
    only answer, so a shard with one large group costs its size for each item outside the group. A shard of many
    items or bytes is dealt over several trees, each of which is asked by all. Texts come along, and pairs are decided where they are
    found: no pair is written but a link.
    """
    named = members.join(labels.withColumnRenamed("component", "of"), "id", "left").withColumn("component", F.coalesce("of", "id")).drop("of")
    counts = named.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("bucket").agg(F.count("*").alias("k"), F.max_by("component", F.struct("n", "component")).alias("main")).where("k > 1").drop("k")
    blocks = F.greatest(F.ceil(F.col("size") / tree), F.ceil(F.col("bytes") / tree_bytes)).cast("long")
    left = written(named.join(mixed, "bucket").withColumn("blocks", blocks), "left").join(texts, "id")
    answer = left.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("asks", F.lit(False))
    ask = left.where("component <> main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
    dealt = answer.unionByName(ask).select("bucket", "block", "asks", "component", "id", "fp", "text")
    dealt = dealt.repartition(slots(members.sparkSession), "bucket", "block").sortWithinPartitions("bucket", "block", "asks", "id")
    return written(dealt.mapInArrow(_across(radius, size, similar), "a long, b long"), "across")


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree often enough."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, ROWS * BANDS) for c in ("sig_a", "sig_b"))
            some = pa.array((x == y).sum(axis=1) >= LIKELY)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(some) for c in ("a", "b")], ["a", "b"])


def _exact(size: int, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, theirs = None, set()
        for batch in batches:
            out = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                if b != hub:
                    hub, theirs = b, shingles(y, size)
                if alike(shingles(x, size), theirs, similar):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def checked(pairs: DataFrame, texts: DataFrame, size: int, similar: float) -> DataFrame:
    """The pairs (a, b) of texts (id, text), one row an id, whose shingles have a Jaccard similarity of `similar` or more. A hub b of many pairs is copied, once for each MEMBERS of them."""
    pairs = written(pairs.distinct(), "pairs")
    parts = pairs.groupBy("b").agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    held = written(texts.join(ids.hint("shuffle_hash"), "id", "left_semi"), "held")
    hubs = held.select(F.col("id").alias("b"), F.col("text").alias("text_b")).join(parts, "b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    own = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), "parts")).join(held.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = own.join(hubs, ["b", "part"]).select("a", "b", "text_a", "text_b")
    return written(both.mapInArrow(_exact(size, similar), "a long, b long"), "checked")


def text_id(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("binary"), F.lit(b"")))


def groups(texts: DataFrame, size: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """(id, component) for each id of texts (id, text) that similar pairs link to another.

    First each shard's groups are stars around their middles. Where a shard's members are not yet of one component, those
    outside the largest are held against all that are near in others. So a group of m near copies costs some m pairs and
    not m squared.
    """
    texts = written(texts.groupBy("id").agg(F.first("text").alias("text")), "texts")
    prints = written(texts.mapInArrow(_sketch(size), "id long, bands array<long>, sig binary, fp long, bytes long"), "sketches")
    dealt = prints.select("id", "fp", "bytes", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("bytes").alias("bytes")).where("size > 1")
    members = written(dealt.drop("bytes").join(shared, "bucket"), "members")
    sig = lambda c: prints.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}"))
    near = stars(members).distinct().join(sig("a"), "a").join(sig("b"), "b").select("a", "b", "sig_a", "sig_b")
    links = checked(near.mapInArrow(_likely, "a long, b long"), texts, size, similar)
    return components(links.unionByName(across(members, components(links), texts, size, similar)))


def keep_one(docs: DataFrame, size: int = SHINGLE, similar: float = SIMILAR) -> DataFrame:
    """docs without near copies: of each component of texts the row with the smallest doc_id stays, once.

    Rows are told apart by doc_id and text, so rows that share a doc_id are judged by their own texts. A row without a
    doc_id stays only where no row of its component has one; null and blank texts are equal to each other. All columns
    stay, whatever their names; an empty table stays empty.
    """
    rows, columns = numbered(docs)
    rows = rows.withColumn("id", text_id(F.col(columns["text"]))).withColumn("key", F.xxhash64("id", F.col(columns["doc_id"]).cast("long")))
    texts = rows.select("id", F.coalesce(F.col(columns["text"]).cast("binary"), F.lit(b"")).alias("text"))
    spark, doc_id = docs.sparkSession, F.col(columns["doc_id"])
    path = shared_folder(spark, "kept")
    with scratch(spark):  # sketches, shards and pairs go once it is known what stays
        found = groups(texts, size, similar).withColumnRenamed("id", "of")
        thin = rows.groupBy("id").agg(F.min(F.struct(doc_id.isNull().alias("no"), doc_id.alias("doc_id"), "key")).alias("least"))
        label = thin.join(found, thin["id"] == found["of"], "left").select("least", F.coalesce("component", "id").alias("component"))
        label.groupBy("component").agg(F.min("least").alias("least")).select("least.key").write.parquet(path)
    until_exit(spark, path)
    kept = spark.read.parquet(path)
    return rows.join(kept.hint("shuffle_hash"), "key", "left_semi").dropDuplicates(["key"]).select(*columns.values()).toDF(*docs.columns)

"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing, with exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import FloatType

from .common import table, written

NEAREST = 20
EVERY = 20
#: Tables; hash functions a table; width of their middle cell, in standard deviations.
TABLES, HASHES, WIDTH, SEED = 4, 7, 2.0, 20
#: Queries that the stop of the visits is fitted on, and the share of their neighbours that must be visited by then.
FIT_QUERIES, REACH = 128, 0.97
#: Vectors and queries that meet in one task, about; vectors of a bucket that is not split further, about.
SHARD, QUERIES, BUCKET = 10_000, 4_000, 2_000
#: One vector in so many gives the bound below which a query's entries are not written.
SAMPLE = 8
_BLOCK = 256


def _normal_below(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in np.ravel(x)]).reshape(np.shape(x))


class Hashing:
    """Gaussian projections of vectors brought to unit length (inner products kept by one more component), cut into cells.

    A function has a middle cell of the given width at a random shift and the two open ends, so a table has at most
    3 ** HASHES cells, however many vectors there are.
    """

    def __init__(self, dim: int, norm: float) -> None:
        rng = np.random.default_rng(SEED)
        self.dim, self.norm = dim, norm
        draws = [rng.standard_normal((dim + 1, HASHES)) for _ in range(TABLES)]
        if dim + 1 >= HASHES:  # orthogonal within a table: each function says something new
            draws = [np.linalg.qr(d)[0] * math.sqrt(dim + 1) for d in draws]
        self.planes = np.stack(draws)
        self.low = rng.uniform(-WIDTH, 0, (TABLES, HASHES))

    def unit(self, x: np.ndarray) -> np.ndarray:
        """Stored vectors, in units of the largest norm, with what they lack to it as one more component."""
        x = x / self.norm
        return np.c_[x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))]

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Queries at unit length; their length does not change the order of inner products."""
        return np.c_[q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))]

    def cells(self, x: np.ndarray, t: int) -> np.ndarray:
        p = x @ self.planes[t]
        digits = (p >= self.low[t]).astype(np.int64) + (p >= self.low[t] + WIDTH)
        return digits @ 3 ** np.arange(HASHES)

    def success(self, q: np.ndarray, t: int, rho: float) -> tuple[np.ndarray, np.ndarray]:
        """3 x queries x functions, to be added up for a cell's digits: log of the chance that a neighbour at cosine rho has the digit, and of how much likelier it has than any vector."""
        p = q @ self.planes[t]
        cuts = np.stack([self.low[t], self.low[t] + WIDTH])
        far = np.diff(_normal_below(cuts), axis=0, prepend=0.0, append=1.0)
        z = (cuts[:, None, :] - rho * p[None]) / math.sqrt(max(1e-6, 1 - rho * rho))
        z = 0.5 * (1 + np.tanh(math.sqrt(2 / math.pi) * (z + 0.044715 * z**3)))  # the normal distribution, near enough
        near = np.log(np.maximum(np.diff(z, axis=0, prepend=np.zeros_like(z[:1]), append=np.ones_like(z[:1])), 1e-12))
        return near, near - np.log(np.maximum(far, 1e-12))[:, None, :]

    @staticmethod
    def of_cells(parts: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """queries x cells: the parts of each cell's digits, added up."""
        return sum(parts[cells // 3**i % 3, :, i] for i in range(HASHES)).T

    def visits(self, q: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
        """queries x (tables * cells), twice: the score by which cells are visited, the best first; and the share of the neighbours that are in a visited cell, on average of the tables, once a cell has had its turn."""
        cells = np.arange(3**HASHES)
        both = [self.success(q, t, rho) for t in range(TABLES)]
        gain = np.concatenate([self.of_cells(g, cells) for _, g in both], axis=1)
        near = np.exp(np.concatenate([self.of_cells(n, cells) for n, _ in both], axis=1))
        order = np.argsort(-gain, axis=1, kind="stable")
        share = np.empty_like(near)
        np.put_along_axis(share, order, np.cumsum(np.take_along_axis(near, order, 1), axis=1) / TABLES, 1)
        return gain, share


def valid(df: DataFrame) -> DataFrame:
    """(vec_id, v): one vector an id (the least, if rows differ), without nulls, zero vectors, and null or non-finite components."""
    kind = "float" if isinstance(df.schema["embedding"].dataType.elementType, FloatType) else "double"  # either holds its values exactly
    v = F.col("embedding").cast(f"array<{kind}>")
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)


def _brute(ids: list[int], queries: np.ndarray, k: int):
    """The k largest inner products of a few queries with each batch of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), queries.shape[1])
            s = queries @ x.T
            m = min(k + 1, s.shape[1])
            top = np.argpartition(-s, m - 1, axis=1)[:, :m]
            own = np.repeat(ids, m)
            flat = top.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(own), batch.column("rep").take(pa.array(flat)), pa.array(np.take_along_axis(s, top, 1).ravel()), batch.column("v").take(pa.array(flat))], ["query_id", "rep", "score", "v"])

    return run


def fit(index: DataFrame, queries: DataFrame, hashing: Hashing, k: int) -> tuple[float, float]:
    """(rho, stop): cosine of a sample's neighbours, and the share at which visits end so that REACH of them have been visited in some table.

    The sample of queries is bounded; its true neighbours come from a pass over every vector.
    """
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_QUERIES).collect()
    ids, q = [r.vec_id for r in sample], np.array([r.v for r in sample], np.float64)
    kind = dict(index.dtypes)["v"]
    found = index.select("rep", "v").mapInArrow(_brute(ids, q, k), f"query_id long, rep long, score double, v {kind}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    rows = found.where("query_id <> rep").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).collect()
    if not rows:
        return 0.5, 1.0
    at = {i: n for n, i in enumerate(ids)}
    own = np.array([at[r.query_id] for r in rows])
    units, asked = hashing.unit(np.array([r.v for r in rows], np.float64)), hashing.asked(q)
    rho = float(np.clip(np.median((units * asked[own]).sum(axis=1)), 0.05, 0.95))
    _, share = hashing.visits(asked, rho)
    turn = np.min([share[own, hashing.cells(units, t) + t * 3**HASHES] for t in range(TABLES)], axis=0)
    return rho, float(np.quantile(turn, REACH, method="higher")) + 1e-9


def _placed(hashing: Hashing, dim: int, coarse: int):
    """A row for each table: the bucket of a vector is its first functions' part of the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = hashing.unit(matrix(batch.column("v"), dim))
            for t in range(TABLES):
                bucket = (hashing.cells(units, t) % 3**coarse).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(units), t, np.int32)), pa.array(bucket)], [*batch.schema.names, "t", "bucket"])

    return run


def _routed(hashing: Hashing, dim: int, coarse: int, rho: float, stop: float):
    """A row for each table and bucket in which a query visits a cell, with the score of the last cell that it visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _BLOCK):
                batch = whole.slice(at, _BLOCK)
                gain, share = hashing.visits(hashing.asked(matrix(batch.column("v"), dim)), rho)
                visited = share <= stop
                cut = np.where(visited, gain, np.inf).min(axis=1)
                some = visited.reshape(len(cut), TABLES, -1, 3**coarse).any(axis=2)
                who, t, bucket = np.nonzero(some)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(who)), batch.column("v").take(pa.array(who)), pa.array(t.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(cut[who]), batch.column("bound").take(pa.array(who))], ["vec_id", "v", "t", "bucket", "cut", "bound"])

    return run


def best(query: np.ndarray, place: np.ndarray, score: np.ndarray, rep: np.ndarray, k: int) -> np.ndarray:
    """Which entries are among their query's k best: largest score, ties to the smaller rep."""
    order = np.lexsort((rep[place], -score, query))
    own = query[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.r_[first, len(own)]))
    return order[rank < k]


def exact(q: np.ndarray, x: np.ndarray, who: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Inner products of pairs in double precision, each added up in the same order wherever it is computed."""
    out = np.empty(len(who))
    for at in range(0, len(who), 50_000):
        out[at : at + 50_000] = np.einsum("ij,ij->i", q[who[at : at + 50_000]], x[pos[at : at + 50_000]])
    return out


def _search(hashing: Hashing, rho: float, k: int, dim: int):
    """A part of one bucket's vectors against some of the queries that visit it: k + 1 best of each query, from the cells that it visits, without those below its bound."""

    def run(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = [("query_id", pa.int64()), ("rep", pa.int64()), ("score", pa.float64()), ("ids", pa.list_(pa.int64()))]
        if not vectors.num_rows or not queries.num_rows:
            return pa.table([pa.array([], t) for _, t in kinds], names=[n for n, _ in kinds])
        t = key[0].as_py()
        vectors, queries = vectors.combine_chunks(), queries.combine_chunks()
        x, q = (matrix(c.column("v").combine_chunks() if isinstance(c.column("v"), pa.ChunkedArray) else c.column("v"), dim) for c in (vectors, queries))
        rep, cuts, bounds = vectors.column("rep").to_numpy(), queries.column("cut").to_numpy(), queries.column("bound").to_numpy()
        cell = hashing.cells(hashing.unit(x), t)
        order = np.argsort(cell, kind="stable")
        cells, first = np.unique(cell[order], return_index=True)
        edges, near = np.append(first, len(order)), x[order]
        slack = 1e-9 * hashing.norm
        out_q, out_v, out_s = [], [], []
        for at in range(0, len(q), _BLOCK):
            block = q[at : at + _BLOCK]
            _, gain = hashing.success(hashing.asked(block), t, rho)
            visited = hashing.of_cells(gain, cells) >= cuts[at : at + _BLOCK, None] - 1e-6  # queries x cells
            s = np.full((len(block), len(order)), -np.inf)
            for c in np.flatnonzero(visited.any(axis=0)).tolist():
                who = np.flatnonzero(visited[:, c])
                s[who, edges[c] : edges[c + 1]] = block[who] @ near[edges[c] : edges[c + 1]].T
            m = min(k + 1, s.shape[1])
            # all that rounding could place among the best, decided by exact scores and the tie rule
            bound = bounds[at : at + _BLOCK]
            least = np.maximum(np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m], bound) - slack * np.linalg.norm(block, axis=1)
            who, pos = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            pos = order[pos]
            score = exact(block, x, who, pos)
            above = score >= bound[who]
            who, pos, score = who[above], pos[above], score[above]
            keep = best(who, pos, score, rep, k + 1)
            out_q.append(who[keep] + at)
            out_v.append(pos[keep])
            out_s.append(score[keep])
        who, pos = pa.array(np.concatenate(out_q)), pa.array(np.concatenate(out_v))
        return pa.table([queries.column("vec_id").take(who), vectors.column("rep").take(pos), pa.array(np.concatenate(out_s)), vectors.column("ids").take(pos)], names=[n for n, _ in kinds])

    return run


def dealt(stored: DataFrame, asked: DataFrame, shard: int = SHARD, at_once: int = QUERIES) -> tuple[DataFrame, DataFrame]:
    """Vectors and queries of (t, bucket) with the keys salt and block, which cut a bucket of many vectors or many queries; each part of its vectors meets each part of its queries once."""
    parts = lambda n, most: F.ceil(F.col(n) / most).cast("int")
    sizes = stored.groupBy("t", "bucket").agg(F.count("*").alias("vectors")).join(asked.groupBy("t", "bucket").agg(F.count("*").alias("queries")), ["t", "bucket"])
    sizes = F.broadcast(sizes.select("t", "bucket", parts("vectors", shard).alias("salts"), parts("queries", at_once).alias("blocks")))  # TABLES * 3 ** HASHES rows at most
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda c, n: F.pmod(F.xxhash64(c, "t"), F.col(n)).cast("int")
    stored = stored.join(sizes, ["t", "bucket"]).withColumn("salt", one("rep", "salts")).withColumn("block", every("blocks"))
    asked = asked.join(sizes, ["t", "bucket"]).withColumn("block", one("vec_id", "blocks")).withColumn("salt", every("salts"))
    return stored.drop("salts", "blocks"), asked.drop("salts", "blocks")


def nearest(df: DataFrame, every: int = EVERY, k: int = NEAREST, shard: int = SHARD, at_once: int = QUERIES, bucket: int = BUCKET) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found by inner product, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; candidates all rows but a query's own. Equal vectors are
    one entry of the index, with the k + 1 smallest of their ids, which is all that a result can hold. A query visits the
    cells of all tables in order of estimated success, up to a fitted share of its neighbours; it is sent to the buckets
    that hold these cells and to no other, and meets at most about `shard` vectors and `at_once` queries in a task. Its
    k + 1 th best score in a sample that is visited alike is a bound: what is below is not among its best and is not written, so
    that a query's entries do not grow with the buckets. Samples grow by SAMPLE from one that is at most about `shard`. A
    query that finds fewer than k is held against every vector. Vectors that are null, empty, zero or hold a null
    or non-finite component take no part, nor do rows without a vec_id; repeated rows count once; vectors of another
    length are a space of their own; an empty table gives an empty one.
    """
    spark = df.sparkSession
    rows = written(valid(df), "vectors")
    out = None
    for (dim,) in rows.select(F.size("v")).distinct().orderBy(F.size("v")).collect():  # the lengths that occur
        own = rows.where(F.size("v") == dim)
        order = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
        index = own.withColumn("n", order).where(F.col("n") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
        index = written(index.select(F.element_at("ids", 1).alias("rep"), "v", "ids"), "index")
        queries = own.where(F.col("vec_id") % every == 0)
        square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        n, norm = index.agg(F.count("*"), F.max(F.sqrt(square))).first()
        hashing = Hashing(dim, norm)
        rho, stop = fit(index, queries, hashing, k) if not queries.isEmpty() else (0.5, 1.0)
        kind = dict(index.dtypes)["v"]
        cut_of = lambda size: max(1, min(HASHES, math.ceil(math.log(max(size / bucket, 1), 3))))

        def placed(vectors: DataFrame, coarse: int) -> DataFrame:
            return vectors.mapInArrow(_placed(hashing, dim, coarse), f"rep long, v {kind}, ids array<long>, t int, bucket int")

        def routed(bounded: DataFrame, coarse: int) -> DataFrame:
            return bounded.mapInArrow(_routed(hashing, dim, coarse, rho, stop), f"vec_id long, v {kind}, t int, bucket int, cut double, bound double")

        def found(vectors: DataFrame, routes: DataFrame) -> DataFrame:
            keys = ["t", "bucket", "salt", "block"]
            a, b = dealt(vectors, routes, shard, at_once)
            return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(_search(hashing, rho, k, dim), "query_id long, rep long, score double, ids array<long>")

        top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "rep"))

        def merged(entries: DataFrame) -> DataFrame:
            entries = entries.groupBy("query_id", "rep").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
            entries = entries.withColumn("n", top).where(F.col("n") <= k + 1).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
            rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
            return entries.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

        bounded = queries.withColumn("bound", F.lit(-math.inf))
        depth = 0
        while n / SAMPLE**depth > shard:
            depth += 1
        for level in range(depth, 0, -1):  # from the smallest sample to one in SAMPLE, each a part of the next
            some = index.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLE**level)) == 0)
            deep = 0 if level == depth else cut_of(n / SAMPLE**level)
            scores = found(placed(some, deep), routed(bounded, deep)).groupBy("query_id", "rep").agg(F.max("score").alias("score"))
            least = scores.withColumn("n", top).where(F.col("n") == k + 1).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
            bounded = written(queries.join(least, "vec_id", "left").select("vec_id", "v", F.coalesce("bound", F.lit(-math.inf)).alias("bound")), "bounded")
        coarse = cut_of(n)
        stored, asked = placed(index, coarse), routed(bounded, coarse)
        near = written(merged(found(stored, asked)), "near")
        full = near.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, own.count() - 1))
        short = written(queries.join(full, queries.vec_id == full.query_id, "left_anti"), "short")
        if not short.isEmpty():  # every bucket of one table, every cell in it
            whole = short.select("vec_id", "v", F.lit(0).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(3**coarse - 1))).alias("bucket"), F.lit(-math.inf).alias("cut"), F.lit(-math.inf).alias("bound"))
            near = near.join(short, near.query_id == short.vec_id, "left_anti").unionByName(merged(found(stored.where("t = 0"), whole)))
        out = near if out is None else out.unionByName(near)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))

"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, numbered, scratch, shared_folder, table, until_exit, written

WEIGHTS = (1, 2, 3)
REPEATS = 3
#: Hex digits of the shuffling hash that name a source's block.
BLOCK_DIGITS = 3
#: Rows of the merged order that one task adds up.
FEW = 100_000


def ranked(values: DataFrame, column: str) -> DataFrame:
    """values (one row each) with `rank` from 0 in order of the column, nulls last: partitions of a sorted table, and their offsets."""
    placed = written(values.sort(F.col(column).asc_nulls_last()).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__part", before.alias("__before"))  # a row for each partition
    joined = placed.withColumn("__part", part).join(offsets, "__part")
    return joined.withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at", "__part", "__before")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weights repeat by rank; shares beyond `repeats` times a source's size go to the others by weight.

    Sources fill up in order of size by weight. The level, words for one unit of weight, is what the full ones leave, shared by
    the weights of the others; it is that of the first source in this order that is not full at it.
    """
    order = F.pmod("rank", F.lit(len(weights)))
    weighted = written(ranked(sizes, "source").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order + 1).cast("int"))), "weighted")
    cap = repeats * F.col("source_size")
    fills = Window.orderBy(cap / F.col("weight"), "rank")  # a row for each source
    total = F.sum("source_size").over(fills.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    full = F.coalesce(F.sum(cap).over(fills.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (total - full) / F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing))
    steps = weighted.select("source_size", "weight", "rank", level.alias("level")).where(cap >= F.col("weight") * F.col("level"))
    level = steps.agg(F.min_by("level", F.struct(cap / F.col("weight"), "rank"))).first()[0] or 0.0
    return weighted.select("source", "source_size", F.least(cap.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def first_over(order: DataFrame, budget: int, few: int = FEW) -> tuple[float, str] | None:
    """(finish, key) of the row, in order of (finish, key), that carries the running sum of size over the budget; None where none does.

    order: size, finish, key. The range of the sort in which it lies is sorted again by itself, until few rows are left.
    """
    rows = None
    while True:
        order = written(order.select("size", "finish", "key").sort("finish", "key").withColumn("at", F.monotonically_increasing_id()), "order")
        sums = order.groupBy(F.shiftright("at", 33).alias("part")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))  # a row for each range of the sort
        run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        over = sums.withColumn("total", F.sum("words").over(run)).where(F.col("total") > budget).orderBy("part").first()
        if not over:
            return None
        order, budget, before, rows = order.where(F.shiftright("at", 33) == over.part), budget - over.total + over.words, rows, over.n
        if rows <= few or rows == before:
            upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            return tuple(order.withColumn("total", F.sum("size").over(upto)).where(F.col("total") > budget).agg(F.min(F.struct("finish", "key"))).first()[0])


def _mixed(rows: DataFrame, weights: tuple[int, ...], repeats: int) -> DataFrame:
    """rows (doc_id, source, size, key, tie and any others) with source_size, target and copies: how often the mix takes each."""
    def finish(turn: Column | int) -> Column:
        return (F.col("source_size") * turn + F.col("sent")).cast("double") / F.col("target")

    spark = rows.sparkSession
    path = shared_folder(spark, "queued")
    with scratch(spark):  # what follows needs the queues and the end, no other table
        sized = written(rows.withColumn("block", F.substring("key", 1, BLOCK_DIGITS)), "sized")
        sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
        budget = sized.agg(F.sum("size")).first()[0] or 0

        def sums(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
            """a and b on equal columns, a null being equal to a null."""
            b = b.withColumnsRenamed({c: f"__{c}" for c in on})
            same = [a[c].eqNullSafe(b[f"__{c}"]) for c in on]
            return a.join(b, same).drop(*[f"__{c}" for c in on])

        blocks = sums(sized.groupBy("source", "block").agg(F.sum("size").alias("block_size")), sources, "source")
        earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.withColumn("before", F.coalesce(F.sum("block_size").over(earlier), F.lit(0))).drop("block_size")
        within = Window.partitionBy("source", "block").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        queued = sums(sized, blocks, "source", "block")
        queued.withColumn("sent", F.col("before") + F.sum("size").over(within)).drop("before", "block").write.parquet(path)
        queued = spark.read.parquet(path)

        rounds = queued.where("size > 0").withColumn("turn", F.explode(F.array(*map(F.lit, range(repeats)))))
        end = first_over(rounds.select("size", "key", finish(F.col("turn")).alias("finish")).where("finish < 2"), budget)
    until_exit(spark, path)
    copies = F.lit(0)
    for turn in range(repeats):
        inside = F.struct(finish(turn).alias("finish"), F.col("key")) < F.struct(F.lit(end[0]).alias("finish"), F.lit(end[1]).alias("key")) if end else F.lit(True)
        copies = copies + F.when((F.col("size") > 0) & (finish(turn) < 2) & inside, 1).otherwise(0)
    return queued.withColumn("copies", copies)


def _sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", *rest: str) -> DataFrame:
    """Thin rows: a document's place in its queue is by a hash of its doc_id, or of its text where it has none."""
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    key = F.md5(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.concat(F.lit(" "), own)))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.regexp_count(own, F.lit(WORD)).cast("long").alias("size"), key.alias("key"), F.xxhash64(own).alias("tie"), *rest)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for each row of docs; taken is a multiple of size.

    Each source is a queue of its documents in order of a hash of doc_id, up to `repeats` times over. A document's virtual
    finish time is the words its queue has sent by its end, divided by the source's target. All queues are merged in order
    of finish time, and the mix ends before the first document that would carry it over the total of all sizes.
    Null and blank texts have size 0 and nothing is taken; a null source is a source of its own, last; rows without a
    doc_id queue by a hash of their text; repeated rows queue one after another; an empty table gives an empty one.
    """
    out = _mixed(_sized(docs), weights, repeats)
    return out.select("doc_id", "source", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it, so that the words written are those taken; size-0 rows take no budget and stay once.

    Rows are written with a number first and told apart by it: rows that share a doc_id, or have none, are each taken by
    themselves. All columns stay, whatever their names.
    """
    plain, columns = numbered(docs)
    rows = written(plain.withColumn("row", F.monotonically_increasing_id()), "rows")
    turns = _mixed(_sized(rows, columns["doc_id"], columns["source"], columns["text"], "row"), WEIGHTS, REPEATS)
    turns = turns.select(F.col("row").alias("of"), F.when(F.col("size") == 0, 1).otherwise(F.col("copies")).alias("turns")).where("turns > 0")
    joined = rows.join(turns.hint("shuffle_hash"), F.col("row") == F.col("of"))
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("turns")))).select(*columns.values()).toDF(*docs.columns)


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("source")


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), ' ' || coalesce(text, ''))) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sized GROUP BY source),
steps AS (
  SELECT *, 3 * source_size AS cap,
         (SELECT sum(source_size) FROM sources)::DOUBLE
         - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS remaining,
         sum(weight) OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS free
  FROM sources),
water AS (SELECT remaining / free AS level FROM steps WHERE cap >= weight * (remaining / free) ORDER BY 3.0 * source_size / weight, source NULLS LAST LIMIT 1),
goals AS (SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM steps, water),
queued AS (
  SELECT s.*, g.source_size, g.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS sent
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source),
turns AS (
  SELECT doc_id, key, size, (turn * source_size + sent)::DOUBLE / target AS finish
  FROM queued, (VALUES (0), (1), (2)) AS t(turn) WHERE size > 0),
cut AS (SELECT *, sum(size) OVER (ORDER BY finish, key ROWS UNBOUNDED PRECEDING) AS total FROM turns WHERE finish < 2),
took AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM cut WHERE total <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT q.doc_id, q.size::BIGINT AS size, q.source_size, round(q.target, 6) AS target, coalesce(t.taken, 0) AS taken
FROM queued q LEFT JOIN took t USING (doc_id)
"""

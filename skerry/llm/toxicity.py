"""Toxicity: a weighted lexicon matched by Aho-Corasick in folded text, normalised by length, with exception phrases."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import id_and_text, steps, table
from .langid import fold

#: Labelled rows that the lexicon and its scale are learned from, at most about so many.
SAMPLE = 20_000
LEXICON = 500
STEM = (4, 8)
#: Least support in toxic documents, in number and as a share of them; share of toxic among documents with the stem; likelihood ratio.
SUPPORT, SHARE, PURITY, RATIO = 3, 0.02, 0.7, 18.0
#: Phrases in which a lexicon word says nothing; others are learned.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "pond scum")

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("абвгдезіјкмнорсѕтухһԁԛԝαβεικνορτυχγɡɩ", "abbrdeeijkmhopcstyxhdqwabeikvoptuxygi"))
#: Digits and signs that stand for letters; signs do so only between letters.
DIGITS = dict(zip("0134578926", "oieastbgzg"))
SIGNS = dict(zip("@$!|", "asii"))
_BETWEEN = re.compile(r"(?<=[^\W_])[@$!|]+(?=[^\W_])")
_ANY_SIGN = re.compile(r"[^\W_][@$!|]")
_ANY_DIGIT = re.compile("[0-9]")
#: A number that touches no letter stands for itself.
_NUMBER = re.compile(r"(?<![^\W_])[0-9]+(?![^\W_])")


class Folding(dict):
    """Code point -> folded character: lower case, no accent, no look-alike, l and i one letter, all else a space."""

    def __missing__(self, point: int) -> str | None:
        char = chr(point).lower()
        if unicodedata.category(chr(point)) in ("Cf", "Mn"):
            out = None
        else:
            char = unicodedata.normalize("NFKD", char)[:1] or char[:1]
            char = HOMOGLYPHS.get(char, char)
            char = DIGITS.get(char, char)
            out = "i" if char == "l" else char if char.isalpha() else " "
        self[point] = out
        return out


FOLDING = Folding()


def folded(text: str) -> str:
    if _ANY_SIGN.search(text):
        text = _BETWEEN.sub(lambda m: "".join(SIGNS[c] for c in m[0]), text)
    if _ANY_DIGIT.search(text):
        text = _NUMBER.sub(" ", text)
    return text.translate(FOLDING)


def stems(words: set[str]) -> set[str]:
    least, most = STEM
    return {w[:n] for w in words if len(w) >= least for n in range(least, min(most, len(w)) + 1)}


def _counted(of: str, lexicon: tuple[str, ...] = ()):
    """(term, toxic, clean): documents that hold a term, added up for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        match = re.compile("|".join(map(re.escape, lexicon))).match if lexicon else None
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = folded((text or b"").decode("utf-8", "replace")).split()
                if of == "stems":
                    counts[y].update(stems(set(words)))
                else:
                    hits = [i for i, w in enumerate(words) if match(w)]
                    counts[y].update({" ".join(words[a : a + 2]) for i in hits for a in (max(0, i - 1), i) if a + 1 < len(words)})
        terms = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([counts[1][t] for t in terms], pa.int64()), pa.array([counts[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])

    return run


class Model:
    """The lexicon's weights, exception phrases, and a logistic scale over weight and weight per word."""

    def __init__(self, weights: dict[str, float], exceptions: set[str], scale: tuple[float, float, float]) -> None:
        self.weights, self.exceptions, self.scale = weights, exceptions, scale

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for stem, w in self.weights.items():
            found.add_word(f" {stem}", (len(stem) + 1, w))
        for phrase in self.exceptions:
            found.add_word(f" {phrase} ", (len(phrase) + 2, 0.0))
        if len(found):
            found.make_automaton()
        return found

    @staticmethod
    def features(automaton, text: bytes) -> tuple[float, float]:
        """Logarithms of the weight of all matches outside exception phrases, and of that per hundred words."""
        if not len(automaton) or not text:
            return 0.0, 0.0
        flat = " " + folded(text.decode("utf-8", "replace"))
        if next(automaton.iter(flat), None) is None:
            return 0.0, 0.0
        flat = f" {' '.join(flat.split())} "  # a phrase's words are next to each other, whatever was between them
        hits = list(automaton.iter(flat))
        inside = [(e - n, e) for e, (n, w) in hits if not w]
        total = sum(w for e, (n, w) in hits if w and not any(a <= e - n and e <= b for a, b in inside))
        return math.log1p(total), math.log1p(100 * total / len(flat.split()))

    def score(self, x: tuple[float, float]) -> float:
        a, b, c = self.scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x[0] + c * x[1]))))


def _features(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in steps(batches):
            xs = [model.features(automaton, t or b"") for t in batch.column("text").to_pylist()]
            a, b = zip(*xs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.float64()), pa.array(b, pa.float64())], ["key", "weight", "density"])

    return run


def fit_scale(rows: list[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton's method; slopes are never negative."""
    if not rows or len({y for *_, y in rows}) < 2:
        return (-2.0, 2.0, 0.5)
    x = np.c_[np.ones(len(rows)), np.array([r[:2] for r in rows])]
    y = np.array([r[2] for r in rows], float)
    ridge, beta = np.diag([1e-3, 0.05, 0.05]), np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    if beta[1] < 0 or beta[2] < 0:
        beta = np.array([-2.0, 2.0, 0.5])
    return tuple(map(float, beta))


def learn(labelled: DataFrame) -> Model:
    """labelled: (text binary, toxic 0/1), a bounded sample. Stems that begin words of toxic documents, weighted by log-odds."""
    labelled = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1)").persist()
    totals = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    weights: dict[str, float] = {}
    phrases = {" ".join(folded(p).split()) for p in EXCEPTIONS}
    if toxic and clean:
        terms = labelled.mapInArrow(_counted("stems"), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
        rate = toxic / (toxic + clean)
        n = F.col("a") + F.col("b")
        ratio = 2 * (F.col("a") * F.log(F.col("a") / (n * rate)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - rate)))).otherwise(0))
        good = terms.where((F.col("a") >= max(SUPPORT, SHARE * toxic)) & (F.col("a") >= PURITY * n)).withColumn("ratio", ratio).where(F.col("ratio") > RATIO)
        rows = good.orderBy(F.desc("ratio"), F.length("term"), "term").limit(20 * LEXICON).collect()
        # best first; a stem that starts another, or is the start of one, is the same evidence again
        best, chosen, starts = [], set(), set()
        for row in rows:
            own = {row.term[:k] for k in range(STEM[0], len(row.term))}
            if len(best) < LEXICON and row.term not in starts and not own & chosen:
                best.append(row)
                chosen.add(row.term)
                starts |= own
        weights = {r.term: math.log((r.a + 0.5) / (toxic + 1)) - math.log((r.b + 0.5) / (clean + 1)) for r in best}
        if weights:
            pairs = labelled.mapInArrow(_counted("phrases", tuple(weights)), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
            phrases |= {r.term for r in pairs.where((F.col("b") >= SUPPORT) & (F.col("b") >= 0.8 * n)).orderBy(F.desc("b"), "term").limit(10 * LEXICON).collect()}
    model = Model(weights, phrases, (0.0, 0.0, 0.0))
    rows = labelled.select("toxic", "text").mapInArrow(_features(model), "key int, weight double, density double").collect()  # the bounded sample
    labelled.unpersist()
    return Model(weights, phrases, fit_scale([(r.weight, r.density, r.key) for r in rows]))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most about `most` labelled documents, drawn by a hash of doc_id; the ids that are sent to all machines are as many."""
    own = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    n, space = own.count(), 1 << 30
    drawn = own.where(F.pmod(F.xxhash64("id"), F.lit(space)) < (space * most // n if n > most else space))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    return texts.join(F.broadcast(drawn), "id").select("text", "toxic")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for each row, from its whole text alone.

    Null and empty texts get the score of a text without a match. Repeated rows score alike, rows without a doc_id like
    any other; other columns stay behind; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in steps(batches):
            scores = [model.score(model.features(automaton, t or b"")) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0)
    model = learn(labelled_sample(docs, labels))
    return score(docs, model).select("doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")

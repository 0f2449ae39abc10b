"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import id_and_text, steps, table

#: The bounded sample that the dictionaries are made of: different texts a language at most, and bytes a language.
SAMPLE_DOCUMENTS = 800
DICTIONARY_BYTES = 256 << 10
#: Texts over this share of a dictionary are taken only where there are too few others.
LONGEST = 1 / 32
CHUNK = 4096
LEVEL = 5
#: The least share by which the best size must beat the second.
MARGIN = 0.01
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
#: What is no letter in ASCII, white space aside, says nothing about a language.
_SIGNS = bytes(c for c in range(128) if not chr(c).isalpha() and c not in b" \n")


def plain(text: str) -> bytes:
    """Lower case, without ASCII signs and digits."""
    return text.lower().encode().translate(None, _SIGNS)


def fold(column: Column, parts: int) -> Column:
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(parts))


def dictionaries(labelled: DataFrame, documents: int = SAMPLE_DOCUMENTS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """By language, raw content of about `size` bytes: whole texts, each once, in order of a hash, up to `documents` of them.

    labelled has text and lang; rows with a null in either are left out, copies of a text count once, and long texts come
    after the others. A text is taken whole or not at all, the first in any case. What the driver gets is bounded by languages x size.
    """
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", F.xxhash64("text", "lang").alias("order"))
    found = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("order").alias("texts")).collect()  # a row for each language
    if not found:
        return {}
    space = 1 << 30  # draw about twice as many as are needed, before texts are sorted
    limit = F.element_at(F.create_map(*[F.lit(x) for r in found for x in (r.lang, min(space, space * 2 * documents // r.texts))]), F.col("lang"))
    drawn = rows.where(F.pmod("order", F.lit(space)) < limit).groupBy("lang", "order").agg(F.first("text").alias("text"))
    drawn = drawn.withColumn("bytes", F.octet_length("text")).withColumn("long", F.col("bytes") > int(size * LONGEST))
    by = Window.partitionBy("lang").orderBy("long", "order")
    taken = drawn.withColumns({"n": F.row_number().over(by), "held": F.sum("bytes").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    texts: dict[str, list[str]] = {}
    for row in taken.where((F.col("n") == 1) | (F.col("n") <= documents) & (F.col("held") <= size)).select("lang", "n", "text").orderBy("lang", "n").collect():
        texts.setdefault(row.lang, []).append(row.text)
    # languages in order of their number of documents: ties go to the first
    return {r.lang: b"\n".join(map(plain, texts[r.lang])) for r in sorted(found, key=lambda r: (-r.rows, r.lang))}


def _predict(content: dict[str, bytes], margin: float):
    langs = list(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers = []
        for lang in langs:
            d = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            packers.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False).compress)
        empty = np.array([len(p(b"")) for p in packers])
        for batch in steps(batches):
            preds, scores, sure = [], [], []
            for text in batch.column("text").to_pylist():
                text = None if text is None else text.decode("utf-8", "replace")
                if text is None or not langs or not _LETTER.search(text):
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    sure.append(False)
                    continue
                text, sizes = plain(text), np.zeros(len(langs))
                for at in range(0, len(text), CHUNK):
                    chunk = text[at : at + CHUNK]
                    sizes += [len(p(chunk)) for p in packers] - empty
                order = np.argsort(sizes, kind="stable")
                best = sizes[order[0]]
                second = sizes[order[1]] if len(langs) > 1 else 2 * best + 1
                gap = float((second - best) / max(second, 1.0))
                preds.append(langs[order[0]])
                scores.append(min(1.0, max(0.0, gap)))
                sure.append(gap >= margin)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(sure, pa.bool_())], ["doc_id", "lang_pred", "score", "accepted"])

    return run


def identify(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """(doc_id, lang_pred, score, accepted) for each row: score is the share by which the best size beats the second.

    A text is compressed whole, in chunks, with each language's dictionary, and chunk sizes are added. accepted is false
    where the margin is narrow. A text that is null or has no letter is `und` with score 0, and so is every text if no
    language was learned; ties go to the first in `content`, the commonest language. Case and ASCII signs are left out. Repeated rows are predicted alike; other columns
    stay behind; an empty table gives an empty one.
    """
    return id_and_text(docs).mapInArrow(_predict(content, margin), "doc_id long, lang_pred string, score double, accepted boolean")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    content = dictionaries(docs.where(F.coalesce(fold(F.col("doc_id"), 4), F.lit(0)) != 2))
    out = identify(docs, content)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "accepted")

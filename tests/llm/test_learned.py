"""Toxicity and language id, whole queries, against plain Python on the smallest tables: learning, folds and predictions."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import pyarrow.parquet as pq
import pytest
import xxhash
import zstandard

from skerry.llm import langid, toxicity

DATA = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{DATA}/{name}.parquet").to_pylist()


def part(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def lexicon(texts):
    """Weights of the stems that begin words of toxic texts, best first, from (words, toxic)."""
    toxic, clean = Counter(), Counter()
    for words, y in texts:
        (toxic if y else clean).update({w[:n] for w in set(words) if len(w) >= 4 for n in range(4, min(8, len(w)) + 1)})
    n_toxic, n = sum(y for _, y in texts), len(texts)
    rate, good = n_toxic / n, []
    for term, a in toxic.items():
        b = clean[term]
        gain = 2 * (a * math.log(a / ((a + b) * rate)) + (b * math.log(b / ((a + b) * (1 - rate))) if b else 0))
        if a >= max(3, 0.02 * n_toxic) and a >= 0.7 * (a + b) and gain > 18:
            good.append((-gain, len(term), term))
    chosen = []
    for _, _, term in sorted(good):
        if not any(term.startswith(c) or c.startswith(term) for c in chosen):
            chosen.append(term)
    return {t: math.log((toxic[t] + 0.5) / (n_toxic + 1)) - math.log((clean[t] + 0.5) / (n - n_toxic + 1)) for t in chosen}


def weigh(words, weights, phrases):
    """Weight of all words that begin with a stem, those inside a phrase left out."""
    inside = {i + k for p in phrases for ws in [p.split()] for i in range(len(words)) if words[i : i + len(ws)] == ws for k in range(len(ws))}
    total = sum(w for i, word in enumerate(words) if i not in inside for stem, w in weights.items() if word.startswith(stem))
    return (math.log1p(total), math.log1p(100 * total / len(words))) if total else (0.0, 0.0)


def test_toxicity_query(spark):
    docs = {r["doc_id"]: r["text"] for r in rows("documents")}
    labels = {r["doc_id"]: r["toxic"] for r in rows("labels") if r["toxic"] is not None and part(r["doc_id"], 5) != 0}
    words = {i: toxicity.folded(t or "").split() for i, t in docs.items()}
    learned = [(words[i], y) for i, y in labels.items() if i in words]
    weights = lexicon(learned)
    docs_df = spark.read.parquet(f"{DATA}/documents.parquet")
    own = spark.read.parquet(f"{DATA}/labels.parquet").where(toxicity.fold(toxicity.F.col("doc_id"), 5) != 0)
    model = toxicity.learn(toxicity.labelled_sample(docs_df, own))
    assert model.weights == pytest.approx(weights)
    a, b, c = model.scale
    got = {r.doc_id: r for r in toxicity.op1_toxicity(spark, DATA).collect()}
    assert got.keys() == docs.keys()
    for i, ws in words.items():
        x, y = weigh(ws, weights, model.exceptions)
        score = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))
        assert got[i].score == pytest.approx(score) and got[i].predicted == (score >= 0.5) and got[i].held_out == (part(i, 5) == 0)


def test_a_phrase_ends_with_its_word():
    model = toxicity.Model({"trash": 3.0}, {"trash can"}, (-2.0, 2.0, 0.0))
    found = model.automaton()
    for text, weight in (("a trash can here", 0), ("a trash, can", 0), ("trash can", 0), ("trash candle", 3), ("trashy", 3), ("a trash", 3), ("trash can trash", 3)):
        assert model.features(found, text.encode())[0] == pytest.approx(math.log1p(weight)), text


def test_toxicity_without_an_id(spark):
    df = spark.createDataFrame([(None, "x y"), (None, "x y"), (None, None)], "doc_id long, text string")
    got = toxicity.score(df, toxicity.Model({"grob": 1.0}, set(), (-2.0, 2.0, 0.5))).collect()
    assert len(got) == 3 and len({r.score for r in got}) == 1


def test_language_query(spark):
    docs = {r["doc_id"]: r for r in rows("documents")}
    of_lang = {}
    for r in docs.values():
        if part(r["doc_id"], 4) != 2 and r["lang"] is not None and r["text"] is not None:
            of_lang.setdefault(r["lang"], []).append(r["text"])
    content = {}
    for lang in sorted(of_lang, key=lambda k: (-len(of_lang[k]), k)):
        key = lambda t: xxhash.xxh64_intdigest(lang.encode(), xxhash.xxh64_intdigest(t.encode(), 42))  # noqa: E731, B023
        signed = lambda t: (key(t) + (1 << 63)) % (1 << 64)  # noqa: E731, B023
        held, texts = 0, []
        for t in sorted(set(of_lang[lang]), key=lambda t: (len(t.encode()) > (256 << 10) // 32, signed(t))):
            held += len(t.encode())
            if not texts or held <= 256 << 10:
                texts.append(t)
        content[lang] = b"\n".join(map(langid.plain, texts))
    assert langid.dictionaries(spark.read.parquet(f"{DATA}/documents.parquet").where(langid.F.coalesce(langid.fold(langid.F.col("doc_id"), 4), langid.F.lit(0)) != 2)) == content
    packers = {k: zstandard.ZstdCompressor(level=5, dict_data=zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False) for k, c in content.items()}
    got = {r.doc_id: r for r in langid.op9_language_id(spark, DATA).collect()}
    assert got.keys() == docs.keys() and all(r.held_out == (part(i, 4) == 2) for i, r in got.items())
    right = held_out = same = seen = 0
    for i, r in docs.items():
        if not any(ch.isalpha() for ch in r["text"] or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        raw = langid.plain(r["text"])
        sizes = {k: sum(len(p.compress(raw[at : at + 4096])) for at in range(0, len(raw), 4096)) for k, p in packers.items()}
        seen += 1
        same += sizes[got[i].lang_pred] <= min(sizes.values()) * 1.01  # tables made for the dictionary once may differ a little
        if got[i].held_out and r["lang"] is not None:
            held_out += 1
            right += got[i].lang_pred == r["lang"]
    assert same >= 0.98 * seen and right >= 0.95 * held_out and held_out > 30


def test_one_language(spark):
    df = spark.createDataFrame([(i, f"bor lin tep {i}", "aa") for i in range(5)] + [(9, "", "aa")], "doc_id long, text string, lang string")
    content = langid.dictionaries(df)
    got = {r.doc_id: r for r in langid.identify(df, content).collect()}
    assert list(content) == ["aa"] and got[0].lang_pred == "aa" and got[0].accepted and 0 <= got[0].score <= 1
    assert (got[9].lang_pred, got[9].accepted) == ("und", False)


def test_narrow_margins_are_not_accepted(spark):
    df = spark.createDataFrame([(1, "zz yy xx", None)], "doc_id long, text string, lang string")
    got = langid.identify(df, {"aa": b"bor lin tep sum " * 20, "bb": b"bor lin tep sum " * 20}).collect()
    assert (got[0].lang_pred, got[0].accepted, got[0].score) == ("aa", False, 0.0)


def test_copies_fill_no_dictionary(spark):
    many = [("the same text again and again " * 20, "aa")] * 500 + [(f"text {i} of its own {i * 7}", "aa") for i in range(60)]
    content = langid.dictionaries(spark.createDataFrame(many, "text string, lang string"), documents=30)["aa"]
    assert content.count(b"of its own") >= 25

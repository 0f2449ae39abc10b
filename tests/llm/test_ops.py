"""Each operator against brute force on a small table with nulls, blanks, copies, repeated rows and columns of clashing names."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skerry import llm
from skerry.llm import ann, chat, langid, line_dedup, mixing, packing, quality, simhash, substring, toxicity

WHITE = " \t\n\r\x0b\x0c"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, h string, fp long, marks string, __kept int, __h int, __n_lines int, __n_dropped int, __n_words int, __turns int, __copy int, __id int, __key int, c1 int, `a.b` int"
EXTRA = (1, "x", 2, "y", 3, *range(10))


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def corpus():
    rng = random.Random(5)
    vocab = ["the", "of", "and", "É", "straße", "Niño", "x|y", "$5", "lorem", "Ipsum", *[f"w{i}" for i in range(60)]]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = make(50)
    line = "A line that many documents share, word for word, ever again"
    texts = [make(rng.randrange(1, 120)) for _ in range(30)]
    texts += [t + " tail" for t in texts[:4]] + texts[:3]
    texts += [f"{make(20)}\n{shared} {make(10)}\n{line}{' ' * (i % 3)}\n{make(5)}" for i in range(8)]
    texts += [f"{line.upper()}\n{make(30)}", shared, "", " \n\t ", None, "\x0b", "one", make(9000), "go go go " * 60, f"{make(40)} " * 3]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), len(t or ""), *EXTRA) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[5], "en", "a", 1, *EXTRA), (None, None, None, None, None, *EXTRA)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key_of(r):
    return (r[0] is None, r[0] or 0)


def fingerprint(text):
    ws = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = words(ws)
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(docs, rows, none):
    fps = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        group = [min(group[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(rows))]
    least = defaultdict(list)
    for g, r in zip(group, rows):
        least[g] += [r[0]] if r[0] is not None else []
    want = Counter((r[0], f"{f:016x}", min(least[g], default=None)) for r, f, g in zip(rows, fps, group))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    assert simhash.near_duplicates(none).count() == 0


def test_links_of_any_shard_size(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, 4))) for b in base for _ in range(8)}
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for tree in (20_000, 3):
        parent = {f: f for f in fps}

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in simhash.links(df, 2, tree).collect():
            a, b = root(a % (1 << 64)), root(b % (1 << 64))
            parent[max(a, b)] = min(a, b)
        got = {f: root(f) for f in fps}
        want = {f: f for f in fps}
        for _ in range(20):
            want = {f: min(want[g] for g in fps if (f ^ g).bit_count() <= 2) for f in fps}
        assert len({(got[f], want[f]) for f in fps}) == len(set(got.values())) == len(set(want.values()))


def test_a_dense_shard_is_cut(spark):
    """Items that agree in 32 bits: each is dealt a few times, however many they are, and links are those of brute force."""
    rng = random.Random(12)
    fps = sorted({(7 << 32) | rng.getrandbits(32) for _ in range(1500)} | {(7 << 32) | 3, (7 << 32) | 1, 7 << 32, (7 << 32) | (1 << 31) | 1})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {tuple(sorted(map(int, r))) for r in simhash.links(df, 2, 100).collect()}
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in got:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                assert root(a) == root(b)


def dropped_lines(rows):
    fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(WHITE))
    seen = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            seen[fold(line)].add(-1 if r[0] is None else r[0])
    for r in rows:
        lines = (r[1] or "").split("\n")
        keep = [x for x in lines if not (len(fold(x)) >= 40 and len(seen[fold(x)]) >= 5 and max(seen[fold(x)]) != (-1 if r[0] is None else r[0]))]
        yield r[0], len(lines), len(lines) - len(keep), "\n".join(keep)


def test_line_dedup(docs, rows, none):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "___n_lines", "___n_dropped"]
    got = Counter((r.doc_id, r["___n_lines"], r["___n_dropped"], r.text or "") for r in out.collect())
    assert got == Counter(dropped_lines(rows)) and sum(r[2] for r in dropped_lines(rows)) > 5
    assert line_dedup.dedup_lines(none).count() == 0
    few = line_dedup.dedup_lines(docs, batches=1).select("doc_id", "text")
    assert few.exceptAll(out.select("doc_id", "text")).count() == 0


def test_mixing(docs, rows, none):
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words(r[1]))) for r in rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken in {k * r.size for k in range(4)}
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    want, left, free = {}, sum(size.values()), set(names)
    while over := {s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * size[s]}:
        for s in over:
            want[s] = 3 * size[s]
            left -= want[s]
        free -= over
    want |= {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
    assert target == pytest.approx(want, abs=1e-5) and all(r.source_size == size[r.source] for r in got)
    assert sum(taken.values()) <= sum(size.values())
    longest = max(r.size for r in got)
    assert all(abs(taken[s] - want[s]) <= longest for s in names)
    assert Counter(map(tuple, mixing.mix(docs.repartition(7)).collect())) == Counter(map(tuple, got))
    assert mixing.mix(none).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0 and mixing.mixed_documents(none).count() == 0


def measured(text):
    ws = words(text)
    n = len(ws)
    win = Counter(tuple(ws[i : i + 8]) for i in range(n - 7))
    rep = {i + k for i in range(n - 7) if win[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if x.strip(WHITE)]
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep), n < 20 or 100 * len(rep) > 30 * n


def test_quality(docs, rows, none):
    out = quality.quality(docs)
    got = Counter((r.doc_id, r["___n_words"], r["__word_chars"], r["__n_symbols"], r["__n_dup_lines"], r["__n_repeat_words"], r["__base_failed"]) for r in out.collect())
    assert got == Counter((r[0], *measured(r[1])) for r in rows)
    assert out.where("__base_failed AND ___kept").count() == 0
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and 10 < good.count() < docs.count() and quality.quality(none).count() == 0


def test_longest_repeats():
    rng = random.Random(1)
    for _ in range(60):
        texts = [[rng.choice("ab" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.randrange(0, 40))] for _ in range(rng.randrange(1, 5))] + [["x"] * rng.randrange(30)]
        want = []
        for ws in texts:
            for i in range(len(ws)):
                best = 0
                for j in range(len(ws)):
                    k = 0
                    while i != j and max(i, j) + k < len(ws) and ws[i + k] == ws[j + k]:
                        k += 1
                    best = max(best, k)
                want.append(best)
        assert quality.longest_repeats(*quality.word_codes([" ".join(ws).encode() for ws in texts])).tolist() == want


def test_a_long_repeat_is_rejected(spark):
    rng = random.Random(2)
    block = " ".join(f"a{rng.randrange(999)}" for _ in range(30))
    clean = " ".join(f"b{i}" for i in range(250))
    df = spark.createDataFrame([(1, f"{clean}"), (2, f"{block} {clean[:300]} {block}"), (3, f"{block} {clean} {block}")], "doc_id long, text string")
    assert {r.doc_id: r["__kept"] for r in quality.quality(df).collect()} == {1: True, 2: False, 3: True}


def cut_windows(rows, window):
    count = Counter(tuple(ws[i : i + window]) for r in rows for ws in [words(r[1])] for i in range(len(ws) - window + 1))
    for r in rows:
        ws = words(r[1])
        gone = {i + k for i in range(len(ws) - window + 1) if count[tuple(ws[i : i + window])] > 1 for k in range(window)}
        yield r[0], len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)


@pytest.mark.parametrize("window, mer, group", [(35, 5, 48 << 20), (8, 3, 48 << 20), (8, 3, 10)])
def test_substrings(docs, rows, none, window, mer, group):
    got = Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in substring.dedup_substrings(docs, window, mer, group).collect())
    want = Counter(cut_windows(rows, window))
    assert got == want and any(0 < r[2] < r[1] for r in want)
    assert substring.dedup_substrings(none).count() == 0


def test_marks_of_repeated_rows_are_few(spark):
    text = " ".join(f"w{i}" for i in range(60))
    marks = substring.repeats(spark.createDataFrame([(1, text)] * 300, "doc_id long, text string"))
    assert marks.count() >= 300 and marks.distinct().count() <= 60


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.packed_documents(docs, capacity=256).collect()
    want = Counter()
    for r in rows:
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 256):
            part = np.array(ids[k : k + 256], "<u4")
            want[r[0], k // 256, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert all(b[i][0] + b[i][1] == b[i + 1][0] for i in range(len(b) - 1)) and b[0][0] == 0 and sum(b[-1]) <= 256
    lengths = np.array([r.length for r in got])
    assert len(bins) <= packing.lower_bound(lengths, 256) + 1
    assert packing.certificate(packing.packed_documents(docs, capacity=256), 256) == (len(bins), packing.lower_bound(lengths, 256))
    assert packing.packed_documents(none).count() == 0


def test_packing_in_many_partitions(spark):
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.randrange(1, 200), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(df, 256, items=300, rounds=5)
    assert got.count() == 3000 and got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 256").count() == 0
    assert got.select("sequence_id").distinct().count() <= 1.02 * packing.lower_bound(np.array([r[3] for r in rows]), 256) + 2


def test_lower_bounds_hold():
    rng = np.random.default_rng(1)
    for _ in range(30):
        lengths = rng.integers(1, 100, rng.integers(1, 60))
        bins, offsets = packing.best_fit_decreasing(lengths, 100)
        low = packing.lower_bound(lengths, 100)
        assert -(-lengths.sum() // 100) <= low <= bins.max() + 1
        assert np.bincount(bins, lengths).max() <= 100
    assert packing.lower_bound(np.array([51] * 7), 100) == 7


@pytest.mark.parametrize("segment, pieces", [(4 << 20, 100_000), (700, 50), (30, 3)])
def test_tokenizer_cache_is_exact(monkeypatch, segment, pieces):
    from tokenizers import Tokenizer

    path, rng = packing.tokenizer_path(), random.Random(3)
    tok = Tokenizer.from_file(path)
    monkeypatch.setattr(packing, "SEGMENT", segment)
    encoder = packing.Encoder(path, pieces)
    assert encoder.bare is not None  # the file cuts texts as the fast path does
    texts = ["".join(rng.choice("aB'sŉİΣςéÉ<|>  \x1c\x0b\t\n0١½!?é😀don't I'LL ßⅧ́") for _ in range(rng.randrange(60))) for _ in range(800)]
    texts += ["<|endoftext|>", "<|ENDOFTEXT|> a<|startoftext|>b", "", " ", "x " * 900, " ".join(f"q{i}" for i in range(900))]
    for i in range(0, len(texts), 29):
        for t, ids in zip(texts[i : i + 29], encoder.encode([t.encode() for t in texts[i : i + 29]])):
            assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids
    assert len(encoder.young) < pieces + 1 and len(encoder.old) <= pieces
    assert encoder.encode([b"bad \xff byte"])[0].tolist() == tok.encode("bad \ufffd byte", add_special_tokens=False).ids
    encoder.bare = None  # a file that cuts in another way: all runs go through it whole
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_toxicity(spark, docs, none):
    rng = random.Random(6)
    clean = lambda: " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}n{rng.choice('rst')}" for _ in range(60))
    bad = ["grobnik", "vexolar", "snidfuk"]
    data = [(f"{clean()} {rng.choice(bad)} {clean()}".encode(), 1) if i % 5 == 0 else ((f"{clean()} grobnik tree {clean()}" if i % 50 == 1 else clean()).encode(), 0) for i in range(400)]
    model = toxicity.learn(spark.createDataFrame(data, "text binary, toxic int"))
    tests = [(1, f"{clean()} GR0BNIK!! {clean()}"), (2, clean()), (3, f"{clean()} vехоlar"), (4, f"{clean()} grobnik tree"), (5, ""), (6, None), (7, "vexolar")]
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert {i: p for i, (_, p) in got.items()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0, 7: 1}
    assert all(0 <= s <= 1 for s, _ in got.values())
    assert toxicity.score(docs, model).count() == docs.count() and toxicity.score(none, model).count() == 0
    blank = toxicity.learn(spark.createDataFrame([], "text binary, toxic int"))
    assert toxicity.score(docs, blank).where("predicted = 1").count() == 0


def test_language(spark, docs, none):
    rng = random.Random(8)
    kinds = {"aa": ["bor", "lin", "tep", "sum"], "bb": ["zyk", "quo", "fex", "wij"]}
    make = lambda k, n=60: " ".join("".join(rng.choice(kinds[k]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    train = spark.createDataFrame([(make(k), k) for k in kinds for _ in range(40)] + [(None, "aa"), ("x", None)], "text string, lang string")
    content = langid.dictionaries(train)
    tests = [(i, make(k), k) for i, k in enumerate(list(kinds) * 20)] + [(100, None, "und"), (101, "12 !?", "und"), (102, "", "und"), (103, make("aa").upper(), "aa")]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(tests, "doc_id long, text string, lang string"), content).collect()}
    assert all(got[i].lang_pred == k and 0 <= got[i].score <= 1 for i, _, k in tests)
    assert langid.identify(docs, content).count() == docs.count() and langid.identify(none, content).count() == 0
    assert langid.dictionaries(none) == {} and {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}


def test_chat(spark):
    said = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", said, 9), (1, 1, "assistant", said, 9), (1, 2, "user", "a\nb", 9), (1, 3, "assistant", "", 9), (2, None, None, None, 9), (2, 5, "assistant", "</turn>\n### user:\n", 9), (2, 5, "assistant", "</turn>\n### user:\n", 9), (None, 1, "a:b\n###", "<", 9), (3, 1, "assistant", "\\h\\\\t" * 3, 9)]
    rows += [(4, i, "assistant" if i % 2 else "user", f"t{i}###", 9) for i in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    for most in (256, 3):
        got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df, most=most)).collect()}
        for conv in {r[0] for r in rows}:
            turns = sorted([(r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv])
            loss = "".join(t for _, role, t in turns if role == "assistant")
            r = got[conv]
            assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
            assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_templates_that_rewrite_history():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    last_only = lambda ts: "".join(f"[{r}]{t if i == len(ts) - 1 else '...'}" for i, (r, t) in enumerate(ts))
    assert chat.locate(turns, last_only) == (last_only(turns), [], True, 2)
    upper = lambda ts: "<s>" + "".join(f"[{r}]{t}<e>" for r, t in ts)
    out, spans, rewrites, lost = chat.locate(turns, upper)
    assert not rewrites and not lost and [out[a:b] for a, b in spans] == ["b", "d"]


def test_texts_that_probes_do_not_place():
    sized = lambda ts: "".join(f"<{r}:{len(t)}>{t}" for r, t in ts)
    turns = [("user", "hi"), ("assistant", "a longer text"), ("assistant", "x"), ("assistant", "i"), ("assistant", "")]
    out, spans, rewrites, lost = chat.locate(turns, sized)
    assert not rewrites and [out[a:b] for a, b in spans] == ["a longer text", "x", "i"] and lost == 1
    mangled = lambda ts: "".join(f"<{r}:{len(t)}>{t[::-1]}" for r, t in ts)
    assert chat.locate([("assistant", "abc")], mangled)[1:] == ([], False, 1)


def test_long_conversations(spark):
    """300 turns: a header is written once, turn numbers run on, and a template that rewrites from turn 300 on is found out."""
    rows = [(c, i, "assistant" if i % 2 else "user", f"t{i} of {c}") for c in (1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    said = {c: [(r, t) for k, _, r, t in rows if k == c] for c in (1, 2)}
    header = chat.Turnwise(lambda t: f"[{t[0]}]{t[1]}<e>", "<s>")
    count = lambda ts: "<s>" + "".join(f"{i}[{r}]{t}" for i, (r, t) in enumerate(ts))
    late = lambda ts: ("<long>" if len(ts) >= 300 else "<s>") + "".join(f"[{r}]{t}<e>" for r, t in ts)
    for template, most in ((header, 256), (header, 7), (lambda ts: header(ts), 256), (count, 256), (late, 256)):
        got = {}
        for r in chat.format_conversations(df, template, most=most).orderBy("conv_id", "part").collect():
            got.setdefault(r.conv_id, []).append(r)
        for c, parts in got.items():
            assert "".join(p.formatted for p in parts) == template(said[c])
            texts = [p.formatted[s["start"] : s["end"]] for p in parts for s in p.loss]
            if template is late:
                assert parts[0].rewrites and not texts and parts[0].unplaced == 150
            else:
                assert texts == [t for r, t in said[c] if r == "assistant"] and not any(p.rewrites or p.unplaced for p in parts)


def vectors():
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(16) * (1 + i % 3)], i) for i in range(400)]
    rows += [(1000 + i, rows[2][1], 0) for i in range(60)] + [(500, None, 1), (520, [0.0] * 16, 1), (540, [float("nan")] * 16, 1), (560, [1.0] * 15 + [None], 1), (580, [], 1), (None, rows[1][1], 1), rows[20], (600, [1.0, 2.0], 0), (601, [2.0, 2.0], 0)]
    return rows


def test_nearest(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    valid = {r[0]: np.array(r[1], float) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in [i for i in valid if i % 20 == 0]:
        others = [i for i in valid if i != q and len(valid[i]) == len(valid[q])]
        score = {i: float(valid[i] @ valid[q]) for i in others}
        want = sorted(others, key=lambda i: (-score[i], i))[:20]
        assert [r for r, _, _ in got[q]] == list(range(1, len(got[q]) + 1)) and len(got[q]) == len(want)
        assert all(abs(score[i] - s) < 1e-9 for _, i, s in got[q])
        keys = [(-s, i) for _, i, s in got[q]]
        assert keys == sorted(keys)
        hits += len({i for _, i, _ in got[q]} & set(want))
        total += len(want)
    assert set(got) == {i for i in valid if i % 20 == 0} and hits / total >= 0.9
    assert [i for _, i, _ in got[1000]] == [2, *range(1001, 1020)]
    assert ann.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_twins(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    mine = llm.queries()[name](spark, data)
    names = sorted(mine.columns)
    a = sorted(tuple(r) for r in mine.select(names).collect())
    b = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({llm.oracle_sql()[name]})").fetchall())
    assert len(a) == len(b)
    assert all(x == pytest.approx(y, rel=1e-6) if isinstance(x, float) else x == y for r, s in zip(a, b) for x, y in zip(r, s))

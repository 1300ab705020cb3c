"""Classifiers, decontamination, near-duplicates, token counts, WARC, images: brute force, round trips, held-out accuracy, edge rows."""

import zlib
import time
import gzip
import collections
import hashlib
import re

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from ticklane.llm import decontam, gbt, images, quality, queries, simhash, tokencount, toxicity, warc
from ticklane.llm.components import components
from ticklane.llm.shared import Scratch, join_totals, slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7) for i, t in texts], DOCS)


EDGES = [(1, None), (2, ""), (3, " \n\t"), (None, "a b c d"), (5, "x" * 300_000), (6, "word " * 60_000), (6, "word " * 60_000), (7, "é漢😀 $%& 12")]


# ---- quality -------------------------------------------------------------------------------------------------------------


def test_trees_fit_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    forest = gbt.fit(x[:2000], y[:2000], trees=40)
    assert ((forest.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def slow_margin(forest, row):
    out = forest.prior
    for feature, cut, value in zip(forest.feature, forest.cut, forest.value, strict=True):
        at = 0
        while feature[at] >= 0:
            at = 2 * at + 1 + int(row[feature[at]] > cut[at])
        out += value[at]
    return out


def test_flat_traversal_equals_a_walk():
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(500, 4)), 1)
    forest = gbt.fit(x, (x[:, 0] + x[:, 1] > 0).astype(float), trees=10)
    assert np.allclose(forest.margin(x), [slow_margin(forest, r) for r in x])


def test_trees_without_two_classes_give_the_prior():
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (gbt.fit(np.zeros((9, 3)), np.ones(9)).score(np.ones((1, 3))) > 0.9).all()


@pytest.mark.parametrize("text", [t for _, t in EDGES])
def test_statistics_are_finite(text):
    assert len(quality.statistics(text)) == len(quality.STATISTICS) and np.isfinite(quality.statistics(text)).all()


def brute_statistics(text):
    """The statistics read off characters and words, one definition a line."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\t-\r ]+", raw)
    if not words:
        return [0.0] * 28
    n, size = len(words), len(raw)
    lines = [x for x in (y.strip(b"\t\n\x0b\x0c\r ") for y in raw.split(b"\n")) if x]
    count = collections.Counter(words)
    share = lambda test: sum(map(test, raw)) / size
    kind = lambda c: "d" if 48 <= c <= 57 else "u" if 65 <= c <= 90 else "l" if 97 <= c <= 122 else "w" if c in b"\t\n\x0b\x0c\r " else "s" if c in b".,;:'\"-?" else "m" if c < 128 else "h"
    p = [k / size for k in collections.Counter(raw).values()]
    line = collections.Counter(lines)
    most = max(line.values())
    top = next(x for x in lines if line[x] == most)
    return [
        np.log(1 + size), np.log(1 + n), share(lambda c: kind(c) == "d"), share(lambda c: kind(c) == "u"), share(lambda c: kind(c) == "m"),
        share(lambda c: kind(c) == "s"), share(lambda c: c >= 0xC0), share(lambda c: kind(c) == "w"), -sum(x * np.log2(x) for x in p),
        sum(map(len, words)) / n, max(map(len, words)), len(count) / n, max(count.values()) / n, sum(k == 1 for k in count.values()) / n,
        sum(w[-1:] in [bytes([c]) for c in b"$%&*#!@^~|=<>+_/\\"] for w in words) / n, sum(len(w) > 1 and w.isupper() for w in words) / n,
        sum(not w.isalpha() and all(c <= 64 for c in w) for w in words) / n, np.log(1 + len(lines)), size / len(lines),
        1 - len(line) / len(lines), sum(len(x) < 25 for x in lines) / len(lines), sum(x[0] in b"-*|>#" for x in lines) / len(lines),
        sum(sorted(count.values())[-5:]) / n, raw.count(b"!") / size, raw.count(b"|") / size, (raw.count(b"{") + raw.count(b"<") + raw.count(b"[")) / size,
        most * len(top) / size, sum(words[i] == words[i + 1] for i in range(n - 1)) / n,
    ]


@given(st.text(alphabet="aBz 09\n\t.!|{<-é漢#*%", max_size=80))
@settings(max_examples=150, deadline=None)
def test_statistics_equal_brute_force(text):
    assert np.allclose(quality.statistics(text), brute_statistics(text))


def brute_fit(x, y, trees, depth, rate, bins, least, ridge):
    """The same boosting by loops over rows; the margin of each row."""
    n, width = x.shape
    prior = np.log((y.sum() + 1) / (n - y.sum() + 1))
    margin = np.full(n, prior)
    cuts = [sorted(set(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]))) for f in range(width)]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + ridge)  # noqa: B023, E731

        def grow(rows, left, g=g, h=h, worth=worth):
            best, gain = None, 1e-6
            for f in range(width) if left else ():
                for cut in cuts[f]:
                    low, high = [r for r in rows if x[r, f] <= cut], [r for r in rows if x[r, f] > cut]
                    rise = worth(low) + worth(high) - worth(rows) if min(len(low), len(high)) >= least else 0
                    if rise > gain * (1 + 1e-9):
                        best, gain = (low, high), rise
            if best is None:
                margin[rows] += -rate * g[rows].sum() / (h[rows].sum() + ridge)
            else:
                for part in best:
                    grow(part, left - 1)

        grow(list(range(n)), depth)
    return margin


def test_split_search_equals_brute_force():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(80, 3)), 1)
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.4)).astype(float)
    how = {"trees": 3, "depth": 3, "rate": 0.3, "bins": 8, "least": 5, "ridge": 1.0}
    assert np.allclose(gbt.fit(x, y, **how).margin(x), brute_fit(x, y, **how))


def test_quality_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op1_quality(spark, d).collect()}
    labels = {r.doc_id: r.quality for r in queries.table(spark, d, "labels").collect()}
    held = [i for i in labels if i in got and got[i].held_out]
    assert np.mean([got[i].predicted == labels[i] for i in held]) > 0.95 and len(got) == 1000


def test_quality_edge_rows(spark):
    labels = spark.createDataFrame([(1, 0), (2, None), (5, 1), (None, 1), (99, 1), (7, 0)], "doc_id long, quality int")
    df = docs(spark, EDGES)
    forest = quality.train(df, labels)
    got = quality.score(df, forest).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(df, forest, 0.0)
    assert kept.columns == df.columns and kept.count() == len(EDGES)
    none = quality.train(docs(spark, []), labels.limit(0))
    assert quality.score(docs(spark, []), none).count() == 0 and {r.score for r in quality.score(df, none).collect()} == {0.5}


# ---- toxicity ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("text", "want"), [("L0ser!", " loser "), ("ｉｄｉｏｔ", " idiot "), ("mоrоn", " moron "), ("id1ot-scum", " idiot scum "), ("2024", " "), (None, " "), ("", " "), ("a  b", " a b "), ("$tupid", " stupid ")])
def test_folding(text, want):
    assert toxicity.fold(text) == want


def toxic_world(spark, n=300):
    rng = np.random.default_rng(5)
    plain = ["the", "cat", "sat", "classic", "on", "grass", "clown", "fish"]
    texts, y = [], []
    for i in range(n):
        words = [plain[k] for k in rng.integers(0, 6, 40)]
        bad = i % 3 == 0
        if bad:
            words[5], words[17] = "grumpster" + "aeiou"[i % 5], "nasty"
        elif i % 3 == 1:
            words[3] = "grumpstock"
        texts.append((i, " ".join(words)))
        y.append((i, int(bad)))
    return docs(spark, texts), spark.createDataFrame(y, "doc_id long, toxic int")


def test_lexicon_learns_stems_and_exceptions(spark):
    df, labels = toxic_world(spark)
    lexicon = toxicity.train(df, labels)
    assert "nasty " in lexicon.weights and any(w.startswith("grumpste") for w in lexicon.weights)
    got = {r.doc_id: r.score for r in toxicity.score(df, lexicon).collect()}
    assert all((got[i] >= 0.7) == (i % 3 == 0) for i in got)
    fresh = docs(spark, [(11, "you n@sty cat " * 3), (12, "the classic grumpstock grass"), (13, "сat on the grass"), *EDGES[:3]])
    scores = {r.doc_id: r.score for r in toxicity.score(fresh, lexicon).collect()}
    assert scores[11] > 0.9 and all(scores[i] < 0.5 for i in (1, 2, 3, 12, 13))
    kept = toxicity.keep_clean(docs(spark, [(1, "nasty grumpstera"), (2, "the cat")]), lexicon)
    assert [r.doc_id for r in kept.collect()] == [2]


def test_final_signs_are_tried_too():
    assert toxicity.folds("a55 grass4 x")[1:] == [" ass grassa x "] and toxicity.folds("assh0l3!") == [" asshol ", " asshole "]
    assert toxicity.folds("in 2024, 5 %")[1:] == [] and toxicity.folds(None) == [" "]
    lexicon = toxicity.Lexicon({"ass ": 2.0, "nasty ": 3.0})
    total, words = toxicity.weigh(["you a55", "a55 nasty", "pass", "nasty5"], lexicon.automaton())
    assert total.tolist() == [2.0, 5.0, 0.0, 3.0] and words.tolist() == [2, 2, 1, 1]


def test_exceptions_take_weight_back():
    lexicon = toxicity.choose([("grump", 50, 2), ("grumpy ", 1, 40), ("rest ", 9, 900)], 60, 1000)
    assert lexicon.exceptions == {"grumpy "}
    total, _ = toxicity.weigh(["grumpy", "grumpster", "GRUMPY grumpa"], lexicon.automaton())
    assert total[0] == 0 and total[1] > 0 and total[2] == pytest.approx(total[1])


def test_phrases_become_exceptions(spark):
    rng = np.random.default_rng(6)
    plain = ["the", "cat", "sat", "on", "mat", "fish"]
    texts, y = [], []
    for i in range(400):
        words = [plain[k] for k in rng.integers(0, 6, 30)]
        if i % 4 == 0:
            words[4], words[20] = "nasty", "skunk"
        elif i % 32 == 1:
            words[7:9] = ["nasty", "weather"]
        elif i % 32 == 2:
            words[7:10] = ["old", "skunk", "river"]
        texts.append((i, " ".join(words)))
        y.append((i, int(i % 4 == 0)))
    lexicon = toxicity.train(docs(spark, texts), spark.createDataFrame(y, "doc_id long, toxic int"))
    assert {"nasty weather ", "old skunk ", "skunk river "} <= lexicon.exceptions and "nasty " not in lexicon.exceptions
    total, _ = toxicity.weigh(["nasty weather", "the nasty cat", "nasty weather nasty cat", "old skunk river"], lexicon.automaton())
    assert total[0] == 0 < total[1] == total[2] and total[3] == 0


def brute_weight(text, lexicon):
    best = 0.0
    for folded in toxicity.folds(text):
        at = lambda key: [(k, k + len(key) + 1) for k in range(len(folded)) if folded.startswith(f" {key}", k)]  # noqa: B023, E731
        spared = [x for key in lexicon.exceptions for x in at(key)]
        best = max(best, sum(w for key, w in lexicon.weights.items() if key not in lexicon.exceptions for a, b in at(key) if not any(c <= a and b <= d for c, d in spared)))
    return best


@given(st.lists(st.text(alphabet="ab5 x", max_size=40), max_size=6))
@settings(max_examples=100, deadline=None)
def test_matches_equal_brute_force(more):
    lexicon = toxicity.Lexicon({"ab": 2.0, "abc ": 1.5, "x ": 1.0, "a": 0.25, "bs ": 4.0}, frozenset({"abx ", "x ab ", "a b x "}))
    texts = ["ab abc abcd abx x xx", "", None, "AB-abc_x", "ab" * 50, "x " * 40, "x ab x", *more]
    total, words = toxicity.weigh(texts, lexicon.automaton())
    assert total.tolist() == pytest.approx([brute_weight(t, lexicon) for t in texts])
    assert words.tolist() == [len(toxicity.fold(t).split()) for t in texts]


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in queries.table(spark, d, "labels").collect()}
    held = [i for i in labels if i in got and got[i].held_out]
    assert len(got) == 1000 and all(got[i].predicted == 0 for i in held if not labels[i])
    assert np.mean([got[i].predicted for i in held if labels[i]]) > 0.8  # a tenth of those labelled 1 hold no telling word


def test_toxicity_edge_rows(spark):
    labels = spark.createDataFrame([(1, 0), (2, None), (5, 1), (None, 1)], "doc_id long, toxic int")
    df = docs(spark, EDGES)
    got = toxicity.score(df, toxicity.train(df, labels)).collect()
    assert len(got) == len(EDGES) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(docs(spark, []), toxicity.train(docs(spark, []), labels)).count() == 0


# ---- decontamination -----------------------------------------------------------------------------------------------------


def brute_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_overlap(text, items, window):
    seq = brute_words(text)
    hit, found = set(), []
    for item, said in items:
        words = brute_words(said)
        ok = False
        for s in range(max(1, len(words) - window + 1) if words else 0):
            part = words[s : s + window]
            for k in range(len(seq) - len(part) + 1):
                if seq[k : k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    ok = True
        if ok:
            found.append(item)
    return len(seq), len(hit), len(found), hashlib.sha256(",".join(sorted(str(i) for i in found if i is not None)).encode()).hexdigest()


ITEMS = [(1, "a b c d e"), (2, "b c"), (3, None), (4, ""), (5, "c d e f"), (10, "É漢 x"), (10, "b c"), (11, "a a a a a"), (None, "c d e"), (12, " ".join("abcdef"[k * k % 6] for k in range(40)))]


@pytest.mark.parametrize(("segment_words", "block_words"), [(1_000_000, 400_000), (7, 3)])
def test_overlaps_equal_brute_force(spark, segment_words, block_words):
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(rng.choice(list("abcdef"), rng.integers(0, 40)))) for i in range(30)] + [(99, None), (98, "A-B.C D"), (97, "é漢 x É漢 X"), (96, "a " * 300), (96, "a " * 300), (None, "b c")]
    got = decontam.overlaps(docs(spark, texts), spark.createDataFrame(ITEMS, "item_id long, text string"), 3, segment_words=segment_words, block_words=block_words)
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got.collect())
    assert rows == sorted((str(i), *brute_overlap(t, ITEMS, 3)) for i, t in texts)


def test_overlaps_with_repeated_and_null_item_ids(spark, duck):
    items = [(10, "a b c"), (10, "b c d"), (None, "c d e")]
    (r,) = decontam.overlaps(docs(spark, [(1, "a b c d e")]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert (r.n_items, r.item_ids) == (3, ["10", "10"]) and r.items_sha256 == hashlib.sha256(b"10,10").hexdigest()
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT 1::BIGINT AS doc_id, 'a b c d e' AS text")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    row = dict(zip([x[0] for x in con.execute(queries.OP2_SQL).description], con.fetchall()[0], strict=True))
    assert (row["n_items"], row["items_sha256"], row["n_hit"]) == (r.n_items, r.items_sha256, r.n_hit)


def test_long_item_in_pieces(spark):
    said = " ".join(f"w{k * 7919 % 1000}" for k in range(3_000))
    blocks = list(decontam.item_blocks(spark.createDataFrame([(1, said), (2, "x")], "item_id long, text string"), 10, 100))
    assert max(sum(len(w) for _, _, w in b) for b in blocks) <= 109 and {r for b in blocks for r, _, _ in b} == {0, 1}
    whole = {tuple(decontam.words(said)[k : k + 10]) for k in range(2_991)}
    assert whole == {tuple(w[k : k + 10]) for b in blocks for r, _, w in b if r == 0 for k in range(len(w) - 9)}


def test_word_filter():
    wanted = decontam.WordFilter(1 << 16)
    terms = [decontam.term(b"%d" % k) for k in range(4_000)]
    for t in terms[:2_000]:
        wanted.add(t)
    found = wanted.holds(np.array(terms, np.int64))
    assert found[:2_000].all() and found[2_000:].sum() < 200 and wanted.holds(np.zeros(0, np.int64)).tolist() == []


def test_overlaps_of_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    (r,) = decontam.overlaps(docs(spark, [(1, "a b")]), items).collect()
    assert (r.n_words, r.n_hit, r.n_items) == (2, 0, 0)
    assert decontam.overlaps(docs(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_matches_equal_brute_force():
    rng = np.random.default_rng(4)
    seq = rng.integers(0, 6, 400)
    phrases = decontam.Phrases([(0, 1, [b"t0", b"t1", b"t2", b"t3"]), (1, 2, [b"t5", b"t5", b"t4"])], 10)
    number = {k: int(np.searchsorted(phrases.terms, decontam.term(b"t%d" % k))) for k in (0, 1, 2, 3, 5, 4)}
    at = [(number[t], i) for i, t in enumerate(seq) if t in number]
    at.sort()
    segment = decontam.Segment(np.array([a for a, _ in at]), np.array([b for _, b in at]), len(phrases.terms))
    for slop in (0, 1, 2):
        got = set(zip(*map(np.ndarray.tolist, segment.matches(phrases, slop)), strict=True))
        for p, want in enumerate(phrases.seq):
            want = want[want >= 0]
            places = {t: {i for x, i in at if x == t} for t in set(want.tolist())}
            near = {s for s in places[int(want[0])] if all(any(abs(s + k - i) <= slop for i in places[int(t)]) for k, t in enumerate(want))}
            assert {s for q, s in got if q == p} == near


def near_hits(said, want, slop):
    """Words of a text inside proximity matches of a phrase."""
    out = set()
    for s, word in enumerate(said):
        if word == want[0] and all(any(0 <= i < len(said) and said[i] == w for i in range(s + k - slop, s + k + slop + 1)) for k, w in enumerate(want)):
            out.update(range(s, min(s + len(want), len(said))))
    return out


def spans_of(spark, texts, items, slop, **how):
    found = decontam.overlaps(docs(spark, list(enumerate(texts))).repartition(how.pop("parts", 1)), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), slop=slop, **how)
    return {r.doc_id: (r.spans, r.item_ids) for r in found.collect()}


def test_proximity_stays_in_a_document(spark):
    got = spans_of(spark, ["x y alpha beta", "gamma delta z", "alpha beta x delta gamma"], ["alpha beta gamma delta"], 4)
    assert got[0] == got[1] == ([], []) and got[2] == ([0, 4], ["0"])
    texts = ["alpha q beta gamma", "gamma gamma gamma alpha", "q gamma beta"]
    for some in (texts, texts[:1]):
        assert spans_of(spark, some, ["alpha beta gamma"], 1)[0] == ([0, 3], ["0"])


@pytest.mark.parametrize("slop", range(5))
def test_proximity_equals_brute_force(spark, slop):
    rng = np.random.default_rng(slop)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 7, rng.integers(0, 60))) for _ in range(25)] + [" ".join(f"w{k}" for k in rng.integers(0, 9, 700)), ""]
    items = ["w1 w2 w3", "w0 w5 w0 w6", "w4 w8 w7 w1 w2", "w3 w3", "w8"]
    first = None
    for parts, segment_words in ((1, 100_000), (4, 30), (7, 64)):
        got = spans_of(spark, texts, items, slop, parts=parts, segment_words=segment_words)
        first = first or got
        assert got == first
    for k, text in enumerate(texts):
        hits = [near_hits(text.split(), item.split(), slop) for item in items]
        spans = got[k][0]
        assert {i for a, b in zip(spans[::2], spans[1::2], strict=True) for i in range(a, b)} == set().union(*hits)
        assert got[k][1] == [str(i) for i, h in enumerate(hits) if h]


def test_keep_uncontaminated(spark):
    df = docs(spark, [(1, "x a b c y"), (2, "a b"), (3, None), (4, "b c")])
    items = spark.createDataFrame([(1, "a b c"), (2, None)], "item_id long, text string")
    kept = decontam.keep_uncontaminated(df, items, 3, segment_words=4)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4] and kept.columns == df.columns
    more = docs(spark, [(None, "a b c"), (None, "c b a"), (1, "a b c"), (1, "x"), (1, "x")]).withColumn("_file", F.lit(1)).withColumn("_row", F.lit(2)).withColumn("_metadata", F.lit(3))
    kept = decontam.keep_uncontaminated(more, items, 3)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "x"), ("1", "x"), ("None", "c b a")] and kept.columns == more.columns
    assert decontam.keep_uncontaminated(docs(spark, []), items).count() == 0 and decontam.keep_uncontaminated(df, items.limit(0)).count() == 4


# ---- near-duplicates -----------------------------------------------------------------------------------------------------


def brute_print(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aB \t\n\x1fé漢.", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint(text) == brute_print(text)


def test_fingerprint_of_many_shingles():
    text = " ".join(str(i % 977) for i in range(70_000))
    assert simhash.fingerprint(text) == brute_print(text)


def brute_components(prints, reach):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= reach:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize(("segments", "reach", "block"), [(3, 4, 2048), (2, 4, 5), (4, 4, 7), (5, 4, 3), (3, 2, 4)])
def test_links_give_all_components(spark, segments, reach, block):
    rng = np.random.default_rng(segments)
    prints = {int(x) for x in rng.integers(0, 2**63, 60)}
    for base in list(prints)[:6]:
        for _ in range(25):
            x = base
            for bit in rng.integers(0, 64, rng.integers(0, 7)):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    scratch = Scratch(spark, "test")
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), scratch, segments, reach, block)
    pairs = [(r.a, r.b) for r in edges.collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= reach for a, b in pairs)
    got = {r.node: r.root for r in components(edges, scratch).collect()}
    want = brute_components(prints, reach)
    group = collections.defaultdict(set)
    for i, x in enumerate(signed):
        group[want[i]].add(got.get(x, x))
    assert all(len(g) == 1 for g in group.values()) and len({next(iter(g)) for g in group.values()}) == len(group)


def test_classes_edge_rows(spark):
    got = sorted((str(r.doc_id), r.component_id, r.fingerprint) for r in simhash.classes(docs(spark, EDGES)).collect())
    assert len(got) == len(EDGES) and [x for x in got if x[0] == "6"][0][1] == 6
    assert {x[1] for x in got if x[0] in "123"} == {1} and ("1", 1, "0" * 16) in got
    assert [x[1] for x in got if x[0] == "None"] == [None]
    assert simhash.classes(docs(spark, [])).count() == 0


def test_keep_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = docs(spark, [(5, text), (3, text), (3, text), (8, text + " end"), (9, "another text of some words"), (None, "lone null id text here"), (1, None), (2, "")])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "9", "None"]


def test_keep_one_of_groups_whose_ids_are_null_or_repeated(spark):
    text = lambda name: " ".join(f"{name}{i}" for i in range(200))
    rows = [(None, text("a")), (None, text("a")), (None, text("b")), (None, text("c")), (5, text("d")), (5, text("e")), (7, text("e")), (9, text("e") + " end"), (None, text("e"))]
    kept = sorted((str(r.doc_id), r.text[0]) for r in simhash.keep_one(docs(spark, rows)).collect())
    assert kept == [("5", "d"), ("5", "e"), ("None", "a"), ("None", "b"), ("None", "c")]


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 40)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + k] == 1000 for k in range(40))
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_one_table_entry_of_many_prints(spark):
    """20,000 fingerprints share a segment's value: its blocks meet in tasks of their own, and links equal brute force."""
    rng = np.random.default_rng(8)
    prints = (rng.integers(0, 2**42, 20_000).astype(np.uint64) << np.uint64(22)) | np.uint64(77)
    prints[:300] = prints[300:600] ^ (np.uint64(1) << rng.integers(22, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(22, 64, 300).astype(np.uint64))
    prints = np.unique(prints)
    near = {tuple(sorted((int(prints[low + i].view(np.int64)), int(prints[j].view(np.int64))))) for low in range(0, len(prints), 2000) for i, j in zip(*np.nonzero(np.bitwise_count(prints[low : low + 2000, None] ^ prints[None, :]) <= 4), strict=True) if low + i != j}
    df = spark.createDataFrame([(x,) for x in prints.view(np.int64).tolist()], "fp long")
    found = {tuple(sorted((r.a, r.b))) for r in simhash.links(df, Scratch(spark, "t")).collect()}
    assert found <= near and len(near) >= 290
    got = {r.node: r.root for r in components(spark.createDataFrame(sorted(found), "a long, b long"), Scratch(spark, "t")).collect()}
    assert all(got[a] == got[b] for a, b in near)


def test_joins_with_totals_of_hot_keys(spark):
    rows = [(1, i) for i in range(2_000)] + [(2 + i % 900, i) for i in range(3_000)] + [(7_777, 1)]
    df = spark.createDataFrame(rows, "k long, v long")
    totals = df.where("k <> 7777").groupBy("k").agg(F.max("v").alias("top"), F.count(F.lit(1)).alias("n"))
    want = collections.defaultdict(list)
    for k, v in rows:
        want[k].append(v)
    got = join_totals(df, totals, ["k"], "n", len(rows)).collect()
    assert sorted((r.k, r.v, r.top, r.n) for r in got) == sorted((k, v, max(want[k]), len(want[k])) for k, v in rows if k != 7_777)


def test_slices_bound_rows_and_bytes():
    import pyarrow as pa

    sizes = [0, 5, 9 << 20, 1, 4 << 20, 4 << 20, 1, *[2] * 1_100]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(sizes))), pa.array([None if not n else "x" * n for n in sizes])], names=["i", "t"])
    parts = list(slices(batch))
    assert pa.Table.from_batches(parts).column(0).to_pylist() == list(range(len(sizes)))
    assert all(p.num_rows == 1 or p.num_rows <= 512 and sum(len(t or "") for t in p.column(1).to_pylist()) <= 8 << 20 for p in parts)
    assert not list(slices(batch.slice(0, 0)))


def test_settle_keeps_one_table(spark, tmp_path):
    from pathlib import Path

    scratch, inner = Scratch(spark, "outer"), []

    def make():
        inner.append(Scratch(spark, "inner"))
        return inner[0].cut(spark.range(5)).where("id > 1")

    out = scratch.settle(make)
    assert out.count() == 3 and not Path(inner[0].base.removeprefix("file://")).exists()


# ---- token counts --------------------------------------------------------------------------------------------------------


def greedy(word, begin, rest):
    i = n = 0
    longest = max(map(len, begin | rest), default=0)
    if "" in begin and not any(word[:j] in begin for j in range(1, longest + 1)):
        n = 1  # the bare mark, then pieces that go on
        begin = rest
    while i < len(word):
        known = rest if i else begin
        j = next((j for j in range(min(len(word), i + longest), i, -1) if word[i:j] in known), None)
        if j is None:
            return 0
        i, n = j, n + 1
    return n


@given(st.sets(st.text("ab", min_size=1, max_size=5), max_size=12), st.sets(st.text("ab", min_size=1, max_size=5), max_size=12), st.lists(st.text("abc", min_size=1, max_size=14), max_size=12))
@settings(max_examples=200, deadline=None)
def test_automaton_equals_greedy(begin, rest, words):
    automaton = tokencount.Automaton(sorted(begin), sorted(rest))
    assert [automaton.count(w) for w in words] == [greedy(w, begin, rest) for w in words]


def test_token_counts_equal_greedy(spark):
    begin, rest = map(set, tokencount.load_pieces(tokencount.default_vocabulary()))
    df = docs(spark, EDGES).unionByName(spark.read.parquet(f"{SMALL}/documents.parquet").limit(20).withColumn("score", F.lit(0)))
    texts = sorted((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())
    got = sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in tokencount.token_counts(df).collect())
    want = []
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        counts = {w: greedy(w, begin, rest) for w in set(words)}
        want.append((i, len(words), sum(counts[w] or 1 for w in words), sum(not counts[w] for w in words)))
    assert sorted(want) == got and max(len(w) for _, t in texts for w in t.split()) == 300_000


def test_words_that_only_the_bare_begin_mark_begins(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokencount.default_vocabulary())
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}

    def marked(word):
        word, i, n = "▁" + word, 0, 0
        while i < len(word):
            i, n = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None), n + 1
            if i is None:
                return 0
        return n

    words = ["2024", "3rd", "ça", "ßa", "ãb", "Ωμέγα", "مرحبا", "日本", "中国人", "hello", "house", "zzz9", "2024😀"]
    assert "▁" in pieces and marked("2024") == 5 and marked("日本") == 3 and marked("2024\ue000") == 0
    got = {r.doc_id: (r.n_tokens, r.n_unknown) for r in tokencount.token_counts(docs(spark, list(enumerate([*words, "2024\ue000"])))).collect()}
    assert got == {i: (marked(w) or 1, not marked(w)) for i, w in enumerate([*words, "2024\ue000"])}


# ---- WARC ----------------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/x", "<html lang=fr><title>T &amp; t</title><p>é <b>b</b><br>c<script>no()</script><!-- no --><a href='/l?a=1&amp;b'>l</a>"), (2, None, None), (3, "u\r\nv", "<script>open"), (1, "http://a/x", "")], "page_id long, url string, html string")
    made = warc.responses(pages)
    every = made.unionByName(warc.derive(made))
    path = str(tmp_path / "w")
    warc.write_warc(every, path)
    back = {r.record_id: r for r in warc.read_warc(spark, path).collect()}
    there = {r.record_id: r for r in every.collect()}
    assert set(back) == set(there) and len(there) == 12
    for key, r in there.items():
        assert bytes(back[key].block) == bytes(r.block) and back[key].headers == r.headers
        had = {h.name: h.value for h in r.headers}
        assert int(had["Content-Length"]) == len(r.block) and had["WARC-Block-Digest"] == warc.digest(bytes(r.block))
        if r.record_type != "response":
            source = {h.name: h.value for h in there[had["WARC-Refers-To"]].headers}
            assert had["WARC-Refers-To-Payload-Digest"] == source["WARC-Payload-Digest"] and had["WARC-Date"] == source["WARC-Date"] and had.get("WARC-Target-URI") == source.get("WARC-Target-URI")
    text = next(bytes(r.block).decode() for r in there.values() if r.record_type == "conversion" and r.key == 1 and r.block)
    assert text == "T & t\né b\ncl"
    meta = next(bytes(r.block).decode() for r in there.values() if r.record_type == "metadata" and r.key == 1 and b"outlink" in bytes(r.block))
    assert "title: T & t\r\n" in meta and "language: fr\r\n" in meta and "outlink: /l?a=1&b\r\n" in meta
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0 and warc.derive(warc.derive(made)).count() == 0


def plain_record(kind, block, *more, length=None):
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{kind}-{len(block)}>", *more, f"Content-Length: {len(block) if length is None else length}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode("latin-1") + block + b"\r\n\r\n"


def test_warc_files_of_others(spark, tmp_path):
    import gzip

    page = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=latin-1\r\n\r\n<html>caf\xe9 <p>WARC/1.0 \r\n\r\n"
    records = [plain_record("warcinfo", b"a: b"), plain_record("response", page, "WARC-Target-URI: http://x/\xe9", "warc-date: d"), plain_record("request", b"")]
    files = {
        "plain.warc": b"".join(records),
        "members.warc.gz": b"".join(map(gzip.compress, records)),
        "whole.warc.gz": gzip.compress(b"".join(records)) + b"\0\0",
        "empty.warc": b"",
        "long.warc": plain_record("resource", b"z" * 3_000_000) + plain_record("metadata", b"m"),
        "long.warc.gz": gzip.compress(plain_record("resource", bytes(range(256)) * 9_000)) + gzip.compress(plain_record("metadata", b"m")),
    }
    got = {}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        got[name] = warc.read_warc(spark, str(tmp_path / name)).collect()
    assert [(r.record_type, bytes(r.block)) for r in got["plain.warc"]] == [("warcinfo", b"a: b"), ("response", page), ("request", b"")]
    assert got["members.warc.gz"] == got["whole.warc.gz"] == got["plain.warc"] and got["empty.warc"] == []
    assert {h.name: h.value for h in got["plain.warc"][1].headers}["WARC-Target-URI"] == "http://x/\xe9"
    assert [len(r.block) for r in got["long.warc"]] == [3_000_000, 1] and [len(r.block) for r in got["long.warc.gz"]] == [256 * 9_000, 1]
    derived = {r.record_type: r for r in warc.derive(warc.read_warc(spark, str(tmp_path / "members.warc.gz"))).collect()}
    assert bytes(derived["conversion"].block).decode() == "caf\xe9\nWARC/1.0" and b"http-status: 404" in bytes(derived["metadata"].block)
    assert {h.name: h.value for h in derived["metadata"].headers}["WARC-Date"] == "d"
    out = str(tmp_path / "again")
    warc.write_warc(warc.read_warc(spark, str(tmp_path / "members.warc.gz")).coalesce(1), out)
    assert warc.read_warc(spark, out).collect() == got["plain.warc"]


def test_warc_records_that_are_cut_or_bare():
    whole = plain_record("response", b"0123456789")
    for size in range(len(whole)):
        found = list(warc.parse(iter([whole[:size]])))
        assert len(found) == (size >= 5)
        if found and size < len(whole) - 4:
            assert found[0]["headers"][-1] == {"name": "WARC-Truncated", "value": "unspecified"}
    bare = b"junk WARC/1.0\r\n\r\nabc\r\n\r\nWARC/1.0\r\nWARC-Type: x\r\nContent-Length: 2\r\n\r\nde"
    for step in (1, 3, 100):
        one, two = warc.parse(iter([bare[i : i + step] for i in range(0, len(bare), step)]))
        assert (one["record_type"], one["block"], one["record_id"][:10]) == ("unknown", b"abc", "<urn:uuid:") and (two["record_type"], two["block"]) == ("x", b"de")
    import gzip

    packed = gzip.compress(whole) + gzip.compress(whole)
    assert [r["block"] for r in warc.parse(warc.unpacked(packed[:-12]))][0] == b"0123456789"
    assert [r["block"] for r in warc.parse(warc.unpacked(gzip.compress(whole) + b"damaged"))] == [b"0123456789"]


def brute_text(page):
    """Visible text by a walk over characters: another way to the conversion's block."""
    import html

    out, i = [], 0
    while i < len(page):
        low = page[i:].lower()
        gone = next((t for t in ("script", "style") if re.match(rf"<{t}\b", low)), None)
        if low.startswith("<!--"):
            end = page.find("-->", i)
            i = len(page) if end < 0 else end + 3
        elif gone:
            end = low.find(f"</{gone}>")
            i = len(page) if end < 0 else i + end + len(gone) + 3
        elif re.match(r"</?[a-z]", low):
            name = re.match(r"</?([a-z0-9]+)", low)[1]
            out.append("\n" if name in warc.BLOCKS else "")
            i = page.index(">", i) + 1
        elif low.startswith("<!"):
            i = page.index(">", i) + 1
        else:
            out.append(page[i])
            i += 1
    return "\n".join(x for x in (" ".join(line.split()) for line in html.unescape("".join(out)).split("\n")) if x)


def test_warc_query_equals_brute_force(spark):
    pages = {r.page_id: r for r in queries.table(spark, SMALL, "pages").collect()}
    got = collections.defaultdict(dict)
    for r in queries.op9_warc(spark, SMALL).collect():
        got[r.page_id][r.record_type] = r
    assert got.keys() == pages.keys()
    for key, page in pages.items():
        text = brute_text(page.html or "").encode()
        made = got[key]["conversion"]
        assert made.block_sha256 == hashlib.sha256(text).hexdigest() and made.content_length == len(text)
        assert made.target_uri == page.url and made.source_digest == warc.digest((page.html or "").encode()) == got[key]["metadata"].source_digest
        assert made.refers_to == got[key]["metadata"].refers_to == warc.response(key, page.url, page.html)["record_id"]


# ---- images --------------------------------------------------------------------------------------------------------------


def picture(seed):
    return np.clip(128 + 50 * np.einsum("k,kyx->yx", np.random.default_rng(seed).normal(0, 0.125, 64), images.textures(64)), 0, 255)


def test_edited_and_cropped_copies_share_a_class(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s in range(12):
        p = picture(s)
        edits = [p, p, p * 0.8 + 20, p[5:, 3:], p + rng.normal(0, 2, p.shape), np.rot90(p)]
        rows += [(10 * s + k, images.encode_pgm(np.ascontiguousarray(e))) for k, e in enumerate(edits)]
    rows += [(900, None), (901, b""), (902, b"P5 junk"), (903, images.encode_pgm(np.full((64, 64), 9.0))), (904, images.encode_pgm(np.full((64, 64), 9.0))), (None, images.encode_pgm(picture(0))), (905, images.encode_pgm(np.zeros((4, 4))))]
    df = spark.createDataFrame(rows, "image_id long, image binary").withColumn("class_id", F.lit("other"))
    got = collections.defaultdict(list)
    for r in images.classes(df.drop("class_id")).collect():
        got[r.image_id].append(r.class_id)
    assert sum(map(len, got.values())) == len(rows)
    ok = sum(got[10 * s + k] == [10 * s] for s in range(12) for k in range(6))
    assert ok >= 68 and all(got[10 * s] == [10 * s] for s in range(12))
    assert got[900] == [900] and got[901] == [901] and got[902] == [902] and got[904] == [903] and got[None] == [0]


def resampled(p, back, shape):
    """The picture whose pixel (y, x) is p at back @ (y, x, 1), between pixels."""
    ys, xs = np.mgrid[: shape[0], : shape[1]].astype(float)
    return images._at(p, *(r[0] * ys + r[1] * xs + r[2] for r in back))


def turned(p, degrees):
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    m = (p.shape[0] - 1) / 2
    return resampled(p, [[c, -s, m - c * m + s * m], [s, c, m - s * m - c * m]], p.shape)


def scaled(p, by):
    calm = images._blurred(p, 0.5 * (1 / by**2 - 1) ** 0.5) if by < 0.7 else p
    return resampled(calm, [[1 / by, 0, 0.5 / by - 0.5], [0, 1 / by, 0.5 / by - 0.5]], (round(p.shape[0] * by),) * 2)


EDITS = {
    "turn 10": lambda p: turned(p, 10), "turn 30": lambda p: turned(p, 30), "turn 45": lambda p: turned(p, 45), "turn 90": np.rot90,
    "half": lambda p: scaled(p, 0.5), "0.8": lambda p: scaled(p, 0.8), "1.5": lambda p: scaled(p, 1.5), "double": lambda p: scaled(p, 2),
    "crop of 9/16": lambda p: p[8:56, 10:58], "corner crop": lambda p: p[16:, 12:], "gamma": lambda p: 255 * (np.clip(p, 0, 255) / 255) ** 1.4,
    "caption": lambda p: np.vstack([p[:50], np.full((14, 64), 240.0)]), "noise": lambda p: p + np.random.default_rng(int(p.sum()) % 999).normal(0, 4, p.shape),
}


def test_recall_of_edited_copies(spark):
    """Sixty pictures, each edit: the share of copies that fall into their picture's class; no two pictures share one."""
    rows = [(s, images.encode_pgm(picture(s))) for s in range(60)]
    for k, edit in enumerate(EDITS.values()):
        rows += [(1000 * (k + 1) + s, images.encode_pgm(np.rint(np.ascontiguousarray(edit(images.decode_pgm(rows[s][1]).astype(float)))))) for s in range(60)]
    got = {r.image_id: r.class_id for r in images.classes(spark.createDataFrame(rows, "image_id long, image binary")).collect()}
    assert all(got[s] == s for s in range(60))
    recall = {name: np.mean([got[1000 * (k + 1) + s] == s for s in range(60)]) for k, name in enumerate(EDITS)}
    assert min(recall.values()) >= 0.9, recall


def all_pairs(made):
    """Least key of each key's class, from consensus of every pair."""
    root = {k: k for k in made}
    for x in made:
        for y in made:
            if x < y and root[x] != root[y] and images.consensus(*made[x], *made[y], images.possible(made[x][0], made[y][0])) >= images.INLIERS:
                old, new = root[x], root[y]
                root = {k: new if r == old else r for k, r in root.items()}
    return {k: min(j for j in made if root[j] == root[k]) for k in made}


@pytest.mark.parametrize("block", [512, 3])
def test_image_classes_equal_those_of_all_pairs(spark, monkeypatch, block):
    rng = np.random.default_rng(4)
    pool, at = rng.integers(0, 256, (50, images.BITS // 8), dtype=np.uint8), rng.uniform(0, 400, (50, 2))
    made = {}
    for k in range(60):  # corners drawn from a pool, so that most entries have several images and third ones as heads
        own = rng.choice(50, 6, replace=False)
        geometry = np.column_stack([at[own] + rng.uniform(0, 50, 2), np.ones(6), np.zeros(6)]).astype(np.float32)
        made[k] = pool[own], geometry
    monkeypatch.setattr(images, "decode_pgm", lambda data: int(bytes(data)))
    monkeypatch.setattr(images, "features", lambda k: made[k])
    monkeypatch.setattr(images, "map_batches", lambda df, function, schema: spark.createDataFrame([r for b in function(iter(df.toArrow().to_batches())) for r in map(tuple, map(dict.values, b.to_pylist()))], schema))
    want = all_pairs(made)
    got = images.classes(spark.createDataFrame([(k, b"%d" % k) for k in made], "image_id long, image binary"), block=block)
    assert {r.image_id: r.class_id for r in got.collect()} == want and 5 < len(set(want.values())) < 50


def test_classes_of_drawn_pictures_equal_those_of_all_pairs(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").limit(60).collect()
    some = [(s, images.encode_pgm(np.rint(np.ascontiguousarray(e(picture(s % 4)))))) for s, e in enumerate(list(EDITS.values())[:12])]
    rows = [(100 + r.vec_id, images.drawn(r.embedding)) for r in vectors] + some
    want = all_pairs({k: images.features(images.decode_pgm(data)) for k, data in rows})
    got = images.classes(spark.createDataFrame(rows, "image_id long, image binary"), block=7)
    assert {r.image_id: r.class_id for r in got.collect()} == want


def test_images_of_vectors(spark):
    rows = [(1, [0.1] * 64), (2, [0.1] * 64), (3, None), (4, [1.0]), (5, [None] * 64), (6, [(-1.0) ** k * 0.1 for k in range(64)])]
    got = images.classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding", read=images.drawn)
    assert {r.vec_id: r.class_id for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def test_images_of_an_empty_table(spark):
    assert images.classes(spark.createDataFrame([], "image_id long, image binary")).count() == 0


def test_pgm_round_trip():
    p = np.arange(12.0).reshape(3, 4)
    assert (images.decode_pgm(images.encode_pgm(p)) == p).all() and images.decode_pgm(b"P5\n9 9\n255\nx") is None


# ---- pipeline ------------------------------------------------------------------------------------------------------------


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "mixing"]
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        before = df.count()
        df = Scratch(spark, "t").cut(stage(spark, df, SMALL))
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"] and 0 < df.count() <= before
    assert corpus_pipeline.run(spark, SMALL).count() == df.count()


@pytest.mark.parametrize("at", range(4))
def test_pipeline_stages_take_edge_rows_and_other_columns(spark, at):
    import corpus_pipeline

    name, stage = corpus_pipeline.STAGES[at]
    more = docs(spark, [*EDGES, (7, "é漢😀 $%& 12")]).withColumn("_row", F.lit("x")).withColumn("_file", F.lit(1)).withColumn("fp", F.lit(2)).withColumn("Root", F.lit(None).cast("string")).withColumn("y", F.lit(3))
    kept = stage(spark, more, SMALL)
    rows = kept.collect()
    assert kept.columns == more.columns and {r._row for r in rows} == {"x"}
    if name == "near_duplicates":  # the three without words are one group, repeated rows fall together
        assert sorted(str(r.doc_id) for r in rows) == ["1", "5", "6", "7", "None"]
    else:
        assert len(rows) == len(EDGES) + 1
    assert stage(spark, more.where("false"), SMALL).count() == 0


def test_pipeline_equals_brute_force(spark):
    """Every stage again on collected texts: scores row by row, all pairs of fingerprints, all windows, and the mix in SQL."""
    import corpus_pipeline
    import duckdb

    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    items = [brute_words(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    left = {r.doc_id: r for r in table.collect()}
    forest = quality.train(table, labels)
    left = {i: r for i, r in left.items() if 1 / (1 + np.exp(-slow_margin(forest, quality.statistics(r.text)))) >= quality.THRESHOLD - 1e-9}
    lexicon = toxicity.train(table.where(F.col("doc_id").isin(list(left))), labels)

    def toxic(text):
        total, n = brute_weight(text, lexicon), len(toxicity.fold(text).split())
        margin = lexicon.bias + lexicon.slopes[0] * np.log(1e-4 + total / max(n, 1)) + lexicon.slopes[1] * np.log1p(total)
        return (1 / (1 + np.exp(-margin)) if total else lexicon.none) >= toxicity.THRESHOLD

    left = {i: r for i, r in left.items() if not toxic(r.text)}
    ids = sorted(left)
    group = brute_components([brute_print(left[i].text) for i in ids], simhash.REACH)
    first = {}
    for i, g in zip(ids, group, strict=True):
        first.setdefault(g, i)
    left = {i: left[i] for i in first.values()}
    windows = {tuple(w[k : k + 10]) for w in items for k in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}

    def dirty(text):
        w = brute_words(text)
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    left = {i: r for i, r in left.items() if not dirty(r.text)}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(r.doc_id, r.text, r.source) for r in left.values()])
    same_rows = con.execute(queries.OP7_SQL)
    names = [x[0] for x in same_rows.description]
    want = sorted((row["doc_id"], row["size"], row["taken"], round(row["target"], 6)) for row in (dict(zip(names, x, strict=True)) for x in same_rows.fetchall()))
    got = sorted((r.doc_id, r.size, r.taken, round(r.target, 6)) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == want and len(got) > 50


def http(body: bytes, *fields: str, kind: str = "text/html") -> list[dict]:
    head = "\r\n".join(["HTTP/1.1 200 OK", f"Content-Type: {kind}", *fields])
    return warc.derivatives({"key": 1, "record_type": "response", "record_id": "<urn:x>", "headers": [], "block": head.encode() + b"\r\n\r\n" + body})


def text_of(records: list[dict]) -> str | None:
    return next((r["block"].decode() for r in records if r["record_type"] == "conversion"), None)


def test_warc_bodies_that_are_packed_or_no_text():
    page = "<p>héllo</p><p>wörld</p>".encode()
    chunks = b"".join(f"{len(page[k : k + 5]):x};x=1\r\n".encode() + page[k : k + 5] + b"\r\n" for k in range(0, len(page), 5)) + b"0\r\n\r\n"
    packed, raw = gzip.compress(page), zlib.compress(page)[2:-4]
    for body, fields in ((page, ()), (chunks, ("Transfer-Encoding: chunked",)), (packed, ("content-encoding: gzip",)), (zlib.compress(page), ("Content-Encoding: deflate",)), (raw, ("Content-Encoding: deflate",)), (page, ("Content-Encoding: gzip", "X: y"))):
        assert text_of(http(body, *fields)) == "héllo\nwörld"
    both = b"".join(f"{len(packed[k : k + 7]):X}\r\n".encode() + packed[k : k + 7] + b"\r\n" for k in range(0, len(packed), 7)) + b"0\r\n\r\n"
    assert text_of(http(both, "Transfer-Encoding: chunked", "Content-Encoding: gzip")) == "héllo\nwörld"
    assert text_of(http(packed[:-9], "Content-Encoding: gzip")) is not None and text_of(http(b"ff\r\n<p>cut", "Transfer-Encoding: chunked")) == "cut"
    assert text_of(http(page, "Transfer-Encoding: chunked")) == "héllo\nwörld" and text_of(http(b"", "Transfer-Encoding: chunked")) == ""
    assert text_of(http(packed, "Content-Encoding: br")) is None
    for kind in ("application/pdf", "image/png"):
        only = http(b"%PDF-1.4 binary", kind=kind)
        assert [r["record_type"] for r in only] == ["metadata"] and f"content-type: {kind}\r\n" in only[0]["block"].decode()
    assert text_of(http(b"a  <b> \n c", kind="text/plain")) == "a  <b> \n c"


@pytest.mark.parametrize("charset", ["idna", "undefined", "punycode", "no-such", "hex", "utf-16", "latin-1", "unicode_escape"])
def test_warc_charsets_never_raise(charset):
    assert len(http("<p>hé</p>".encode("latin-1") + b"\xff\\N{x", kind=f"text/html; charset={charset}")) == 2


def test_warc_plain_files_are_read_in_linear_time():
    one = plain_record("resource", b"q" * 5_000)
    data = one * 16_000
    took = time.process_time()
    assert sum(1 for _ in warc.parse(warc.unpacked(data))) == 16_000
    assert time.process_time() - took < 6
    bare = b"WARC/1.0\r\nWARC-Type: x\r\n\r\n" + b"r" * 3_000_000
    assert [len(r["block"]) for r in warc.parse(warc.unpacked(bare + b"\r\n\r\n" + bare))] == [3_000_000, 3_000_000]


def test_warc_of_a_table_with_clashing_columns(spark):
    pages = spark.createDataFrame([(1, "http://x", "<p>a</p>", "k", "r", 3)], "page_id int, url string, html string, key string, block string, headers int")
    assert warc.derive(warc.responses(pages)).count() == 2

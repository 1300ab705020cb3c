"""Language spans, source divergence, Merkle manifest: brute force, held-out accuracy, edge rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from ticklane.llm import divergence, langid, manifest, queries
from ticklane.llm.shared import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- manifest


def H(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def plain_leaf(r, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)])


def plain_levels(nodes, arity=8):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def plain_path(levels, i, arity=8):
    out = []
    for level in levels[:-1]:
        b = i // arity * arity
        run = level[b : b + arity]
        out.append((run[: i - b], run[i - b + 1 :]))
        i //= arity
    return out


def plain_audit(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, plain_leaf(r, r[1]), r))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in langs:
        groups[x].sort(key=lambda v: v[:3])
        trees[x] = plain_levels([v[2] for v in groups[x]])
    top = plain_levels([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, (_, _, leaf, r) in enumerate(groups[x]):
            path = plain_path(trees[x], i) + plain_path(top, k)
            hit = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0
            node = plain_leaf(r, r[1].translate(LOWER) if hit and r[1] is not None else r[1])
            for a, b in path:
                node = H(*a, node, *b)
            root = top[-1][0]
            out.append((r[0], leaf, trees[x][-1][0], root, H(*[s for a, b in path for s in a + b]), node, node == root))
    return sorted(out, key=repr)


def edge_docs():
    rng = random.Random(5)
    rows = [(i, f"Text {i} É{'x' * rng.randrange(40)}", "en", f"s{i % 3}", i) for i in range(130)]
    rows += [(1000 + i, "Gleich", "de", "s1", 1) for i in range(9)] + [(2000, "alone", "fr", None, None)]
    rows += [(3000 + i, None if i % 2 else "", None, "s", 0) for i in range(65)] + [(None, "Null ID", "en", "s", 2)] * 2 + [(7, "Other Text of 7", "en", "s", 3), (7, "Other Text of 7", "en", "s", 3)]
    return rows + [(4000 + i, "Y" * 100_000 if i == 3 else "Z", f"l{i:02}", "s", None) for i in range(12)]


def got_audit(frame):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("rows", [edge_docs(), edge_docs()[:8], edge_docs()[:9], edge_docs()[:64], [(1, "A", None, None, None)], []], ids=["all", "one run", "two runs", "full", "leaf", "none"])
def test_manifest_equals_plain_trees(spark, rows):
    assert got_audit(manifest.audit(spark.createDataFrame(rows, DOCS))) == plain_audit(rows)


def test_manifest_with_a_joined_table_of_offsets(spark, monkeypatch):
    from ticklane.llm import shared

    monkeypatch.setattr(shared, "FEW_ROWS", 0)
    rows = edge_docs()[120:150]
    assert got_audit(manifest.audit(spark.createDataFrame(rows, DOCS))) == plain_audit(rows)


def test_manifest_of_clashing_columns_and_text_ids(spark):
    rows = [(str(i), "AbC", "en", "s", i, "p", "k", 1, 2, 3) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string, n_chars long, place string, key string, _seen long, _part int, nodes long")
    found = manifest.audit(docs).collect()
    assert len(found) == 20 and {r.verified for r in found} == {True, False} and len({r.root for r in found}) == 1


def test_proofs_tell_whose_leaf_it_is(spark):
    rows = edge_docs()[:100]
    docs = spark.createDataFrame(rows, DOCS)
    found = manifest.proofs(manifest.build(docs, Scratch(spark, "t"))).collect()
    for r in found:
        node = r.digest
        for s in r.steps:
            node = H(s.left, node, s.right)
        assert node == r.root
    assert len({r.place for r in found}) == 100
    other = [(*r[:1], r[1] + "!", *r[2:]) if r[0] == 50 else r for r in rows]
    assert manifest.build(spark.createDataFrame(other, DOCS), Scratch(spark, "t")).root != found[0].root
    assert manifest.build(docs.repartition(7), Scratch(spark, "t")).root == found[0].root


# --- divergence


def plain_divergence(rows, least=3, most=200):
    P = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    n, docs, groups = Counter(), Counter(), defaultdict(set)
    for r in rows:
        lang, source = r[2] or "", r[3] or ""
        groups[lang].add(source)
        words = P.findall((r[1] or "").translate(LOWER))
        n.update((lang, source, w) for w in words)
        docs.update({(lang, w) for w in words})
    out = set()
    for lang, sources in groups.items():
        kept = sorted((w for (x, w), k in docs.items() if x == lang and k >= least), key=str.encode)
        total = {s: sum(n[lang, s, w] for w in kept) for s in sources}
        share = lambda c, t: 1 + 10**9 * (c + 1) // (t + len(kept))  # noqa: E731, B023
        p = {s: {w: share(n[lang, s, w], total[s]) for w in kept} for s in sources}
        q = {w: share(sum(n[lang, s, w] for s in sources), sum(total.values())) for w in kept}
        for s in sources:
            pairs = [(o, sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept)) for o in sources if o != s]
            telling = [(w, (p[s][w] - q[w]) ** 2 // q[w]) for w in kept if n[lang, s, w] and p[s][w] > q[w]]
            for part, items in (("pair", pairs), ("term", telling)):
                for k, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or k <= most:
                        out.add((lang, s, part, item, value, k))
    return out


def word_docs(count, seed=3):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abÉñz漢😀") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 20 + 40 * (i % 7)]).title() for _ in range(rng.randrange(60))), rng.choice(["en", "de", None]), rng.choice(["a", "B", "é", None, "hot", "hot", "hot"]), 1) for i in range(count)]
    return rows + [(None, None, "en", "empty", 0), (1, "", "xx", "p", 0), (1, "once", "xx", "q", 0), (2, "tie1 tie2", "yy", "p", 0), (2, "tie1 tie2", "yy", "q", 0), (3, "TIE2, tie1.", "yy", "q", 0)]


@pytest.mark.parametrize("count", [400, 0])
def test_divergence_equals_plain_counts(spark, count):
    docs = spark.createDataFrame(word_docs(count), DOCS).repartition(5)
    found = divergence.audit(docs, most_terms=25).collect()
    assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in found} == plain_divergence(word_docs(count), most=25)
    assert len(found) == len(set(found))


def test_divergence_of_no_rows_and_other_columns(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([("a b c", "en", "s", 1, "x", 2)] * 3, "text string, lang string, source string, n int, term string, kept int")
    assert divergence.audit(docs).count() == 0  # one source: no pair, and no term is more frequent than in its lang


def test_chunks_split_anywhere(spark, monkeypatch):
    rng = np.random.default_rng(2)
    keys = sorted({(f"t{rng.integers(40):02}", f"s{rng.integers(6)}") for _ in range(300)})
    expected = {k: 3 * (i + 1) for i, k in enumerate(keys)}
    parts = [{"lang": "en", "bucket": 0, "terms": [t for t, _ in some], "sources": [x for _, x in some], "n": [expected[k] // 3 for k in some], "docs": [1] * len(some)} for some in (keys[::2], keys[1::2]) * 3]
    rows = divergence.merged(pa.Table.from_pylist(parts, divergence.COUNTS))
    assert rows["term"].to_pylist() == [t for t, _ in keys] and rows["docs"].to_pylist() == [3] * len(keys)
    for chunk, cells in ((16_384, 1 << 19), (7, 1 << 19), (50, 30)):
        monkeypatch.setattr(divergence, "CHUNK", chunk)
        monkeypatch.setattr(divergence, "CELLS", cells)
        got = {}
        for b in divergence.encode("en", rows, 1):
            r = b.to_pylist()[0]
            cell = np.array(r["counts"]).reshape(len(r["sources"]), -1)
            assert r["terms"] == sorted(r["terms"]) and list(cell.sum(axis=1)) == r["totals"] and cell.shape[1] <= chunk
            got |= {(t, s): int(cell[i, j]) for i, s in enumerate(r["sources"]) for j, t in enumerate(r["terms"]) if cell[i, j]}
        assert got == expected


def test_tallies_keep_the_most_telling():
    rng = np.random.default_rng(4)
    groups = [{"source": s, "n": 1000} for s in ("a", "b")]
    tally = divergence.Tally(["a", "b"], np.zeros((2, 2), np.int64), [(np.zeros(0, np.int64), []) for _ in range(2)])
    every = {"a": {}, "b": {}}
    for k in range(40):
        counts = rng.integers(0, 4, (2, 10))
        words = [f"w{k:02}{j}" for j in range(10)]
        tally.add({"terms": words, "sources": ["a", "b"], "counts": counts.ravel(), "groups": groups, "kept": 400}, 15)
        p = [divergence.shares(c, 1400) for c in counts]
        q = divergence.shares(counts.sum(axis=0), 2400)
        for i, s in enumerate("ab"):
            every[s] |= {w: int((x - y) ** 2 // y) for w, x, y, c in zip(words, p[i], q, counts[i], strict=True) if c and x > y}
    got = [r for b in tally.rows("en") for r in b.to_pylist() if r["part"] == "term"]
    for s in "ab":
        best = sorted(every[s].items(), key=lambda x: (-x[1], x[0]))[:15]
        assert set(best) <= {(r["item"], r["value"]) for r in got if r["source"] == s}


def test_shares_are_exact_beyond_64_bits():
    counts = np.array([0, 5, 123_456_789_012, 3 * 10**14], np.int64)
    total = 10**15 + 7
    assert list(divergence.shares(counts, total)) == [1 + 10**9 * (int(c) + 1) // total for c in counts]


# --- languages


@pytest.fixture(scope="module")
def model(spark):
    return langid.train(queries.table(spark, SMALL, "documents"))


def best_value(score):
    total = score[0].astype(int)
    for row in score[1:]:
        total = np.maximum(total, total.max() - langid.SWITCH * langid.UNIT) + row
    return int(total.max())


def value(score, path):
    return int(score[np.arange(len(score)), path].sum()) - int((np.diff(path) != 0).sum()) * langid.SWITCH * langid.UNIT


def test_paths_are_the_best():
    rng = np.random.default_rng(1)
    scores = [-rng.integers(0, 512, (rng.integers(1, 80), 3)).astype(np.int32) for _ in range(200)]
    scores += [np.repeat(-rng.integers(0, 512, (rng.integers(1, 6), 4)), 15, axis=0).astype(np.int32)[:, :3] for _ in range(100)]
    for score, path in zip(scores, langid.viterbi(scores), strict=True):
        assert value(score, path) == best_value(score)
    sure = [(s, one) for s in scores if (one := langid.single(s)) is not None]
    assert sure and all(value(s, np.full(len(s), one)) == best_value(s) for s, one in sure)


def test_held_out_languages(spark, model):
    docs = queries.table(spark, SMALL, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = [r for r in queries.op11_language(spark, SMALL).collect() if r.held_out]
    assert len(found) > 40 and sum(r.lang_pred == truth[r.doc_id] for r in found) >= 0.97 * len(found)
    assert all(0 <= r.score <= 1 for r in found)


def test_spans_of_mixed_texts(spark, model):
    texts = {lang: [r.text for r in queries.table(spark, SMALL, "documents").where(f"lang = '{lang}' and length(text) > 500").collect()] for lang in model.langs}
    said = [[("en", texts["en"][i][:300]), ("de", texts["de"][i % 9][:250]), ("fr", texts["fr"][i % 9][:200])] for i in range(9)]
    docs = spark.createDataFrame([(i, "".join(t + " 123, " for _, t in x)) for i, x in enumerate(said)], "doc_id long, text string")
    right = letters = 0
    for r in langid.spans(docs, model).collect():
        edges = np.cumsum([0, *(len(t) + 6 for _, t in said[r.doc_id])])
        for k, (lang, text) in enumerate(said[r.doc_id]):
            letters += len(text)
            right += sum(max(0, min(s.end, edges[k] + len(text)) - max(s["first"], edges[k])) for s in r.spans if s.lang == lang)
    assert right > 0.9 * letters


SCRIPT_TEXTS = {"ru": "привет мир это русский текст", "el": "γειά σου κόσμε", "ja": "これは日本語の文章です", "zh": "这是一个中文句子漢字", "hi": "यह हिन्दी का वाक्य है", "th": "นี่คือประโยคภาษาไทย", "en": "this is plain English", "ko": "안녕하세요 세계"}


def test_scripts_narrow_candidates(spark):
    rows = [(i, text, lang) for i in range(40) for lang, text in SCRIPT_TEXTS.items()]
    learnt = langid.train(spark.createDataFrame([(k, t, lang) for k, (_, t, lang) in enumerate(rows)], "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(lang, text.upper() * 3) for lang, text in SCRIPT_TEXTS.items()], "doc_id string, text string")
    assert all(r.lang_pred == r.doc_id for r in langid.predict(docs, learnt).collect())
    mixed = spark.createDataFrame([(1, "this is plain English привет мир это русский текст this is English")], "doc_id int, text string")
    assert [s.lang for s in langid.spans(mixed, learnt).collect()[0].spans] == ["en", "ru", "en"]


def test_language_edge_rows(spark, model):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ,.! ٣", None), (None, "the and of", None), (None, "the and of", None), (5, "漢字" * 50_000, "en"), (6, "the " * 60_000, "en"), (7, "ǅİ ́a", "en"), (8, "\x00😀 a\x00b", "en")]
    rows = [(a, b and b.encode("utf-16", "surrogatepass").decode("utf-16"), c) for a, b, c in rows]
    docs = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    found = [(r.doc_id, r.lang_pred, r.score) for r in langid.predict(docs, model).collect()]
    assert found[:3] == [(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)] and found[3] == found[4] and found[3][1] == "en" == found[6][1]
    assert found[5][1:] == (model.langs[0], round(1 / len(model.langs), 9)) and len(found) == 9
    assert langid.predict(docs.limit(0), model).count() == 0
    none = langid.train(docs.limit(0))
    assert {(r.lang_pred, r.score) for r in langid.predict(docs, none).collect()} == {("und", 0.0)}
    assert langid.spans(docs, none).collect()[5].spans == []


def test_scores_do_not_depend_on_neighbours(model):
    texts = ["the and of", "der die das und", "x" * 1000, "la le les " * 30, ""]
    one = [langid.judge(*x, model.langs) for t in texts for x in langid.label([t], model)]
    assert [langid.judge(*x, model.langs) for x in langid.label(texts * 40, model)] == one * 40

"""Toxicity: a weighted lexicon matched by an Aho-Corasick automaton after folding look-alike characters and digits.

Folding lower-cases, turns look-alike letters of other alphabets, full-width letters and digits inside words into plain
letters and everything that is no letter into a single space, so that each word stands between spaces; where digits or signs
end a word, the text is also tried with those turned into letters, and the heavier reading counts.  The lexicon is learnt from
a bounded, hash-drawn sample of labelled rows (``most_rows``): word beginnings of ``BEGINNINGS`` letters and whole words of
any length whose document frequency speaks for label 1, each with a log-odds weight.  Words that contain an entry but speak
against it, and phrases of two or three words around an entry that do, become exceptions: an entry inside one has no weight.
A document's score is the logistic of the weight per word and of its total, calibrated on the same sample.

Defined cases: a null or empty text has no matches and the lowest score; a null id and repeated rows are scored like any
row; without labelled rows of both classes the lexicon is empty and every score is the smoothed prior; texts and words of any
length are read whole; an empty table gives an empty table; other columns are never read.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.shared import Scratch, map_batches

from ticklane.llm.quality import keep_rows, training_rows

MOST_ROWS = 20_000
THRESHOLD = 0.7
HOLD_OUT = (3, 1)
#: Documents of label 1 that an entry must occur in, and the log-odds it must reach.
SUPPORT, LEAST_WEIGHT = 4, 2.5
#: Log-odds under which a word or phrase of at least SUPPORT documents of label 0 is an exception.
HARMLESS = 0.5
#: Letters of the word beginnings that are tried as entries (matches go on in words of any length).
BEGINNINGS = range(3, 13)

# Letters of other alphabets that look like plain ones.
LOOKALIKES = {
    "а": "a", "ӓ": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k",
    "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w", "ɑ": "a", "ɡ": "g", "ı": "i",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c",
}
# Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "€": "e"}

_TABLE = str.maketrans(LOOKALIKES)
_HIDDEN = re.compile("[­​-‏⁠﻿]")
_INSIDE = re.compile(r"(?<=[^\W\d_])[0134578@$!€9]+(?=[^\W\d_])|(?<![^\W])[0134578@$€9](?=[^\W\d_]{2})")
_FINAL = re.compile(r"(?<=[^\W\d_])[0134578@$€9]+(?![^\W_])")
_OTHER = re.compile(r"[\W\d_]+")


def _letters(text: str) -> str:
    return f" {_OTHER.sub(' ', text).strip()} ".replace("  ", " ")


def folds(text: str | None) -> list[str]:
    """Folded words with a space before, between and behind them (one space if there are none); a second reading where digits
    or signs that stand for letters end a word."""
    text = (text or "").lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text)).lower()
        if any("ɐ" <= c < "԰" for c in set(text)):
            text = text.translate(_TABLE)
    plain = lambda m: "".join(SUBSTITUTES[c] for c in m[0])
    text = _INSIDE.sub(plain, text)
    return [_letters(text), *([_letters(_FINAL.sub(plain, text))] if _FINAL.search(text) else [])]


def fold(text: str | None) -> str:
    """The first reading of a text."""
    return folds(text)[0]


@dataclass
class Lexicon:
    """Entries with their weights and exceptions, in folded letters; a trailing space asks for the word's end."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    #: Logistic of bias + slopes . (log weight per word, log total weight).
    bias: float = 0.0
    slopes: tuple[float, float] = (0.0, 0.0)
    none: float = 0.5  # score without any match

    def automaton(self):
        """Values: length and weight of an entry, length and None of an exception (which also wins over an equal entry)."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for word, weight in [*self.weights.items(), *((w, None) for w in self.exceptions)]:
            found.add_word(f" {word}", (len(word) + 1, weight))
        if len(found):
            found.make_automaton()
        return found


def _weight(folded: str, automaton) -> float:
    """Total weight of the entries that lie in no exception."""
    hits, spared = [], []
    for end, (size, weight) in automaton.iter(folded):
        (spared if weight is None else hits).append((end - size + 1, end, weight))
    if hits and spared:
        spared.sort(key=lambda x: x[0])
        starts = np.array([x[0] for x in spared])
        reach = np.append(-1, np.maximum.accumulate([x[1] for x in spared]))
        first, last = np.array([(x[0], x[1]) for x in hits]).T
        covered = reach[np.searchsorted(starts, first, side="right")] >= last
        hits = [x for x, c in zip(hits, covered, strict=True) if not c]
    return sum(x[2] for x in hits)


def weigh(texts: list, automaton) -> tuple[np.ndarray, np.ndarray]:
    """Total weight of the matches, in the heavier reading, and number of words of each text."""
    total, words = np.zeros(len(texts)), np.zeros(len(texts))
    for i, text in enumerate(texts):
        read = folds(text)
        words[i] = max(0, read[0].count(" ") - 1)
        if len(automaton):
            total[i] = max(_weight(x, automaton) for x in read)
    return total, words


def _features(total: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.log(1e-4 + total / np.maximum(words, 1)), np.log1p(total)], axis=1)


def rate(total: np.ndarray, words: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    found = 1 / (1 + np.exp(-np.clip(lexicon.bias + _features(total, words) @ np.array(lexicon.slopes), -30, 30)))
    return np.round(np.where(total > 0, found, lexicon.none), 9)


def _terms(text: str | None) -> set[str]:
    """Word beginnings and, with a space behind, whole words."""
    out = set()
    for word in {w for read in folds(text) for w in read.split()}:
        out.add(word + " ")
        out.update(word[:k] for k in BEGINNINGS if k < len(word))
    return out


def _entry_in(word: str, entries) -> bool:
    """Does the word begin with an entry, or is it one? word has a space behind."""
    return word in entries or any(word[:k] in entries for k in BEGINNINGS if k < len(word))


def _phrases(text: str | None, entries, exceptions) -> set[str]:
    """Phrases of two and three words around each entry that is in no exception."""
    out = set()
    for read in folds(text):
        words = read.split()
        for i, word in enumerate(words):
            if f"{word} " not in exceptions and _entry_in(f"{word} ", entries):
                out.update(" ".join(words[a:b]) + " " for a, b in ((i - 1, i + 1), (i, i + 2), (i - 1, i + 2)) if a >= 0 and b <= len(words))
    return out


def _odds(p: int, n: int, ones: int, zeros: int) -> float:
    return float(np.log((p + 0.5) / (ones + 1)) - np.log((n + 0.5) / (zeros + 1)))


def choose(counts: list[tuple[str, int, int]], ones: int, zeros: int) -> Lexicon:
    """Lexicon from (term, documents of label 1, of label 0): entries that are as long as their support allows, shortest first."""
    pos = {t: p for t, p, _ in counts}
    odds = {t: _odds(p, n, ones, zeros) for t, p, n in counts}
    good = {t for t, p, _ in counts if p >= SUPPORT and odds[t] >= LEAST_WEIGHT}
    longer: dict[str, list[str]] = {}
    for t in good:
        longer.setdefault(t[:-1], []).append(t)
        if t.endswith(" "):  # a whole word also follows the beginning that lacks its last letter
            longer.setdefault(t[:-2], []).append(t)
    entries: dict[str, float] = {}
    for t in sorted(good, key=lambda t: (len(t), t)):
        if _entry_in(t, entries):
            continue
        if any(pos[x] >= 0.9 * pos[t] for x in longer.get(t, [])):
            continue  # a longer beginning says as much
        entries[t] = odds[t]
    against = {t for t, _, n in counts if t.endswith(" ") and n >= SUPPORT and odds[t] < HARMLESS and t not in entries and _entry_in(t, entries)}
    return Lexicon(entries, frozenset(against))


def spare(lexicon: Lexicon, phrases: list[tuple[str, int, int]], ones: int, zeros: int) -> Lexicon:
    """The lexicon with those of (phrase, documents of label 1, of label 0) as exceptions that speak for no label 1; none that holds a shorter one."""
    harmless = sorted((t for t, p, n in phrases if n >= SUPPORT and _odds(p, n, ones, zeros) < HARMLESS), key=lambda t: (t.count(" "), t))
    kept: set[str] = set()
    for t in harmless:
        w = t.split()
        if not any(f"{a} {b} " in kept for a, b in itertools.pairwise(w)):
            kept.add(t)
    return Lexicon(lexicon.weights, lexicon.exceptions | kept)


def _calibrate(lexicon: Lexicon, total: np.ndarray, words: np.ndarray, y: np.ndarray) -> None:
    """Logistic regression by Newton's method on documents with matches; the rest have one smoothed score."""
    hit = total > 0
    lexicon.none = float((y[~hit].sum() + 0.5) / ((~hit).sum() + 1.0))
    x, t = np.column_stack([np.ones(hit.sum()), _features(total[hit], words[hit])]), y[hit]
    center, w = x[:, 1:].mean(axis=0) if hit.any() else np.zeros(2), np.zeros(3)
    x[:, 1:] -= center
    if hit.any():
        smooth = np.clip(t, 0.02, 0.98)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(3), x.T @ (smooth - p) - 0.5 * w * np.array([0, 1, 1]))
        w[1:] = np.maximum(w[1:], 0.0)  # more weight never lowers a score
    lexicon.bias, lexicon.slopes = float(w[0] - center @ w[1:]), (float(w[1]), float(w[2]))


def _document_counts(rows: DataFrame, terms) -> DataFrame:
    """term, n: in how many of the texts each of terms(text) occurs; summed in each task first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()

        def flush():
            found = list(tally)
            out = pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([tally[t] for t in found], pa.int64())], names=["term", "n"])
            tally.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                tally.update(terms(text))
                if len(tally) > 400_000:
                    yield flush()
        yield flush()

    return map_batches(rows.select("text"), counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, labels: DataFrame, target: str = "toxic", held: tuple[int, int] = HOLD_OUT, most_rows: int = MOST_ROWS, seed: int = 29) -> Lexicon:
    """Learn from labelled rows whose crc32(doc_id) mod held[0] is not held[1].

    What reaches the driver are terms of the sample with their counts: those in SUPPORT documents of label 1, words of label 0
    that begin with an entry, and phrases around entries.
    """
    texts, y = training_rows(docs, labels, target, held, most_rows, seed)
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.cut(texts.join(y, "doc_id").select("text", "y"))
    ones, zeros = (sum(r.n for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect() if r.y == k) for k in (1, 0))
    bad, good = rows.where("y = 1"), rows.where("y = 0")
    often = F.col("n") >= SUPPORT
    # what label 1 says often enough bounds what is counted for label 0, in tables that fit a task
    p = dict(_document_counts(bad, _terms).where(often).collect())
    n = dict(_document_counts(good, lambda text, known=frozenset(p): [t for t in _terms(text) if t in known]).collect()) if p else {}
    counts = [(t, k, n.get(t, 0)) for t, k in p.items()]
    lexicon = choose(counts, ones, zeros)
    if lexicon.weights:
        begun = lambda text, entries=frozenset(lexicon.weights): [t for t in _terms(text) if t[-1] == " " and _entry_in(t, entries)]
        against = dict(_document_counts(good, begun).where(often).collect())
        lexicon = choose([*counts, *((t, 0, k) for t, k in against.items() if t not in p)], ones, zeros)
        entries, spared = frozenset(lexicon.weights), lexicon.exceptions
        phrases = dict(_document_counts(good, lambda text: _phrases(text, entries, spared)).where(often).collect())
        said = dict(_document_counts(bad, lambda text, known=frozenset(phrases): [t for t in _phrases(text, entries, spared) if t in known]).collect()) if phrases else {}
        lexicon = spare(lexicon, [(t, said.get(t, 0), k) for t, k in phrases.items()], ones, zeros)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            total, words = weigh(batch.column(0).to_pylist(), automaton)
            yield pa.RecordBatch.from_arrays([pa.array(total), pa.array(words), batch.column(1)], names=["total", "words", "y"])

    found = map_batches(rows, weighed, "total double, words double, y int").toArrow()  # three numbers a sampled row
    total, words, y = (np.array(found[c].to_pylist(), float) for c in ("total", "words", "y"))
    order = np.lexsort((y, words, total))
    _calibrate(lexicon, total[order], words[order], y[order])
    scratch.drop(rows)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, column: str = "score") -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value.automaton()
        for batch in batches:
            found = rate(*weigh(batch.column(1).to_pylist(), automaton), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", column])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), scored, f"doc_id {kind}, {column} double")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def judge():
        automaton = shared.value.automaton()
        return lambda texts: rate(*weigh(texts, automaton), shared.value) < threshold

    return keep_rows(docs, judge)

"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are read off the UTF-8 bytes of a whole text (byte histogram, words, lines); the trees are learnt on the driver
from a bounded sample of labelled rows (``most_rows``, drawn by a hash of doc_id, the same in every run) and sent to the
executors as flat arrays of a few hundred KB, where whole batches walk down them together.  Texts are never shuffled.

Defined cases: a null text counts as empty; an empty text has statistics 0; a null id, repeated rows and ids are scored
like any row; labels that are null or for unknown ids are left out; without labels, or with one class, every score is the
smoothed prior; an empty table gives an empty table; columns of the table are never read by name but text and doc_id.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklane.llm.gbt import Forest, fit
from ticklane.llm.shared import crc_remainder, hash_share, map_batches, text_bytes

#: Labelled rows that the trees are learnt from, about.
MOST_ROWS = 20_000
THRESHOLD = 0.3
HOLD_OUT = (5, 0)

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_HIGH = np.arange(256) >= 0xC0
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_SENTENCE = np.isin(np.arange(256), [ord(c) for c in ".,;:'\"-?"])
_MARK = (np.arange(256) < 128) & ~(_DIGIT | _UPPER | _LOWER | _SPACE | _SENTENCE)
_ENDS = frozenset(b"$%&*#!@^~|=<>+_/\\")

STATISTICS = (
    "log_chars", "log_words", "digit_share", "upper_share", "mark_share", "sentence_share", "high_share", "space_share", "entropy",
    "word_length", "longest_word", "distinct_share", "top_word_share", "single_share", "marked_word_share", "upper_word_share",
    "wordless_share", "log_lines", "line_length", "repeated_line_share", "short_line_share", "bullet_line_share", "stop_share",
    "exclaim_share", "pipe_share", "brace_share", "top_line_share", "adjacent_repeat_share",
)


def statistics(text: str | None) -> list[float]:
    """The numbers of STATISTICS for a whole text."""
    raw = text_bytes(text)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = max(1, len(raw))
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    p = counts[counts > 0] / chars
    often = Counter(words)
    lines = [x.strip() for x in raw.split(b"\n")]
    lines = [x for x in lines if x]
    repeated = Counter(lines)
    top_line = repeated.most_common(1)[0]
    marked = upper = wordless = length = longest = 0
    for word, k in often.items():
        size = len(word)
        length += size * k
        longest = max(longest, size)
        if word[-1] in _ENDS:
            marked += k
        if word.isupper() and size > 1:
            upper += k
        if not word.isalpha() and not any(c > 64 for c in word):
            wordless += k
    top = often.most_common(5)
    m = len(lines)
    return [
        np.log1p(len(raw)), np.log1p(n), counts[_DIGIT].sum() / chars, counts[_UPPER].sum() / chars, counts[_MARK].sum() / chars,
        counts[_SENTENCE].sum() / chars, counts[_HIGH].sum() / chars, counts[_SPACE].sum() / chars, float(-(p * np.log2(p)).sum()),
        length / n, longest, len(often) / n, top[0][1] / n, sum(k == 1 for k in often.values()) / n, marked / n, upper / n,
        wordless / n, np.log1p(m), len(raw) / m, 1 - len(repeated) / m, sum(len(x) < 25 for x in lines) / m,
        sum(x[:1] in b"-*|>#" for x in lines) / m, sum(k for _, k in top) / n,
        counts[33] / chars, counts[124] / chars, (counts[123] + counts[60] + counts[91]) / chars, top_line[1] * len(top_line[0]) / chars,
        sum(a == b for a, b in itertools.pairwise(words)) / n,
    ]


def matrix(texts: list) -> np.ndarray:
    return np.array([statistics(t) for t in texts], float).reshape(len(texts), len(STATISTICS))


def sample_share(labels: DataFrame, most_rows: int) -> float:
    """Share of ids to draw so that about most_rows labelled rows are among them."""
    n = labels.count()
    return min(1.0, most_rows / n) if n else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, target: str, held: tuple[int, int], most_rows: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Sampled documents (doc_id, text) and training labels (doc_id, y): one label an id, held-out ids left out."""
    y = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), held[0]) != held[1]))
    y = y.groupBy("doc_id").agg(F.max((F.col(target) == 1).cast("int")).alias("y"))
    share = sample_share(y, most_rows)
    return docs.select("doc_id", "text").where(hash_share(F.col("doc_id"), seed) < share), y.where(hash_share(F.col("doc_id"), seed) < share)


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", held: tuple[int, int] = HOLD_OUT, most_rows: int = MOST_ROWS, seed: int = 17, **how) -> Forest:
    """Learn from the labelled rows whose crc32(doc_id) mod held[0] is not held[1]; labels has doc_id and target."""
    texts, y = training_rows(docs, labels, target, held, most_rows, seed)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_batches(texts, measured, f"doc_id {kind}, x array<double>").join(y, "doc_id").select("doc_id", "x", "y").toArrow()
    found = sorted(zip(rows["doc_id"].to_pylist(), rows["x"].to_pylist(), rows["y"].to_pylist(), strict=True))  # in every run the same order
    return fit(np.array([x for _, x, _ in found], float).reshape(len(found), len(STATISTICS)), np.array([y for _, _, y in found], float), **how)


def score(docs: DataFrame, forest: Forest, column: str = "score") -> DataFrame:
    """doc_id and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.round(shared.value.score(matrix(batch.column(1).to_pylist())), 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["doc_id", column])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), scored, f"doc_id {kind}, {column} double")


def keep_rows(docs: DataFrame, make) -> DataFrame:
    """Rows of docs, all columns as they are, that a judge keeps: make() is called once a task and gives a function from a list of
    texts to a boolean array."""
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = make()
        for batch in batches:
            yield batch.filter(pa.array(np.asarray(judge(batch.column(at).to_pylist()), bool)))

    return map_batches(docs, kept, T.StructType(docs.schema.fields))


def keep_good(docs: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    return keep_rows(docs, lambda: lambda texts: np.round(shared.value.score(matrix(texts)), 9) >= threshold)

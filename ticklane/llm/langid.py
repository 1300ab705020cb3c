"""Language identification: script ranges narrow a word's candidates, Viterbi over word scores labels the spans of a text.

A word is a run of letters and marks of one script, cut every ``PIECE`` characters (for scripts without spaces).  Its score for
a language is the sum of log-probabilities of its letter sequences of ``ORDERS`` characters and of the word itself, looked up in
hashed tables that are learnt from about ``PER_LANG`` texts a language (drawn by a hash of the id).  Languages that hardly write the
word's script are no candidates.  A word speaks for or against a language by ``MOST`` nats at most, and a change of language costs
``SWITCH`` nats, so a few stray words open no span.  Scores are whole numbers (``UNIT`` a nat): sums do not depend on batches.

Defined cases: a null text and one without letters are ``und`` with score 0 and no spans; so is everything if nothing was learnt; a text whose
scripts no learnt language writes gets the first language by name with the score 1 / languages; ties go to the first language by
name; rows without lang are not learnt from; null ids and repeated rows are rows like any; texts of any length are read whole;
an empty table gives an empty table; other columns are never read.  The model has ``BUCKETS`` x languages numbers of two bytes.
"""

from __future__ import annotations

import functools
import itertools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.shared import crc_remainder, hash_share, map_batches

PER_LANG = 5_000
HOLD_OUT = (3, 1)
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
PIECE, BLOCK = 24, 1 << 19
UNIT, MOST, SWITCH = 64, 8, 12
#: Share of a sequence's probability that is spread over all buckets; least share of its letters for a language to write a script.
SPREAD, LEAST_SHARE = 0.01, 0.01
NONE = "und"

# Unicode ranges of scripts, by their first and last code point.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFC)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
_LAST, _INHERITED = 0x323B0, 255
# Odd multipliers of the hash.
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1, 0xD6E8FEB9, 0x7FEB352D], np.uint32)
_SHIFT = np.uint32(32 - (BUCKETS - 1).bit_length())


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: script (0: not in words, 1: any other, _INHERITED: mark without a script), letter, lower case."""
    kind, letter, lower = np.zeros(_LAST, np.uint8), np.zeros(_LAST, bool), np.arange(_LAST, dtype=np.uint32)
    for c in range(_LAST):
        category = unicodedata.category(chr(c))[0]
        if category in "LM":
            kind[c] = 1 if category == "L" else _INHERITED
            letter[c] = category == "L"
            low = chr(c).lower()
            if len(low) == 1:
                lower[c] = ord(low)
    for i, ranges in enumerate(SCRIPTS.values(), 2):
        for first, last in ranges:
            inside = slice(first, last + 1)
            kind[inside] = np.where(kind[inside] > 0, i, 0)
    return kind, letter, lower


def code_points(text: str | None) -> np.ndarray:
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < _LAST, codes, 0) if len(codes) and codes.max() >= _LAST else codes


def words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First character, end and script of each word."""
    kind, letter, _ = tables()
    script = kind[codes]
    marks = script == _INHERITED
    if marks.any():
        at = np.maximum.accumulate(np.where(marks, 0, np.arange(len(codes))))
        script = np.where(script[at] == _INHERITED, 0, script[at])
    edges = np.concatenate([[0], np.flatnonzero(np.diff(script)) + 1, [len(codes)]]) if len(codes) else np.zeros(1, int)
    begin, end = edges[:-1], edges[1:]
    inside = script[begin] > 0 if len(begin) else np.zeros(0, bool)
    begin, end = begin[inside], end[inside]
    parts = -(-(end - begin) // PIECE)
    if len(parts) and parts.max() > 1:
        number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(begin, parts) + number * PIECE
        end = np.minimum(begin + PIECE, np.repeat(end, parts))
    if len(begin):
        count = np.concatenate([[0], np.cumsum(letter[codes])])
        some = count[end] > count[begin]
        begin, end = begin[some], end[some]
    return begin, end, script[begin]


def features(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """For each order, the bucket of the sequence that starts at each character from begin[0] to end[-1] (BUCKETS where it is in no
    word); and the bucket of each word, by the sum of its sequences' hashes."""
    base, size = int(begin[0]), int(end[-1] - begin[0])
    chars = tables()[2][codes[base : base + size]]
    first, last = np.zeros(size, np.uint32), np.zeros(size, np.uint32)
    first[begin - base], last[end - base - 1] = _MIX[4], _MIX[5]
    depth = np.zeros(size + 1, np.int8)
    depth[begin - base] = 1
    depth[end - base] -= 1
    inside = np.cumsum(depth[:-1], dtype=np.int8).astype(bool)
    follows = inside.copy()  # goes on with the word of the character before
    follows[begin - base] = False
    out, raw, bag = [], np.zeros(size, np.uint32), np.zeros(size, np.uint32)
    ok = inside
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            ok = ok[:-1] & follows[n - 1 :]
        raw = raw[: size - n + 1] + chars[n - 1 :] * _MIX[n - 1]
        if n not in ORDERS:
            continue
        h = raw + first[: size - n + 1] + last[n - 1 :]
        h += np.uint32(n)
        h ^= h >> np.uint32(15)
        h *= _MIX[6]
        found = np.full(size, BUCKETS, np.int64)
        np.copyto(found[: size - n + 1], h >> _SHIFT, where=ok)
        out.append(found)
        bag[: size - n + 1] += np.where(ok, h, np.uint32(0))
    whole = np.add.reduceat(bag, begin - base, dtype=np.uint32) + (end - begin).astype(np.uint32) * _MIX[3]
    whole ^= whole >> np.uint32(15)
    out.append((whole * _MIX[6] >> _SHIFT).astype(np.int64))
    return out


def blocks(begin: np.ndarray, end: np.ndarray) -> Iterator[slice]:
    """Runs of words of about BLOCK characters."""
    ends, low = np.cumsum(end - begin), 0
    while low < len(begin):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK, side="right")))
        yield slice(low, high)
        low = high


@dataclass
class Model:
    """langs by name; logs: whole-number log-probabilities of langs x buckets (and a 0 for no sequence); writes: scripts x langs."""

    langs: list[str]
    logs: np.ndarray
    writes: np.ndarray

    def score(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, script: np.ndarray) -> np.ndarray:
        """words x langs: how far each language falls short of the word's best candidate, 0 to -MOST nats."""
        out = np.zeros((len(begin), len(self.langs)), np.int32)
        for part in blocks(begin, end):
            *sequences, whole = features(codes, begin[part], end[part])
            starts = begin[part] - begin[part.start]
            for k, log in enumerate(self.logs):
                each = log.take(sequences[0])
                for more in sequences[1:]:
                    each += log.take(more)
                out[part, k] = np.add.reduceat(each, starts, dtype=np.int32) + log.take(whole)
        out //= len(ORDERS) + 1
        able = self.writes[script]
        none = ~able.any(axis=1)
        best = np.where(able, out, np.iinfo(np.int32).min).max(axis=1, initial=np.iinfo(np.int32).min)
        out = np.where(able, np.maximum(out - best[:, None], -MOST * UNIT), -MOST * UNIT)
        out[none] = 0
        return out


def fit(langs: list[str], counts: np.ndarray, letters: np.ndarray) -> Model:
    """counts: buckets x langs; letters: scripts x langs."""
    p = (1 - SPREAD) * counts / np.maximum(counts.sum(axis=0), 1) + SPREAD / len(counts)
    writes = letters >= np.maximum(LEAST_SHARE * letters.sum(axis=0), 1)
    logs = np.zeros((len(langs), len(counts) + 1), np.int16)
    logs[:, :-1] = np.round(np.log(p) * UNIT).T
    return Model(langs, logs, writes)


def train(docs: DataFrame, held: tuple[int, int] = HOLD_OUT, per_lang: int = PER_LANG, seed: int = 41) -> Model:
    """Learn from text and lang of rows with a lang whose crc32(doc_id) mod held[0] is not held[1]: about per_lang texts a language."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (crc_remainder(F.col("doc_id"), held[0]) != held[1]))
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    share = F.lit(float(per_lang)) / F.col("size")
    some = rows.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang").where(hash_share(F.col("doc_id"), seed) < share).select("lang", "text")
    scripts = len(SCRIPTS) + 2

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = found.setdefault(lang, np.zeros(BUCKETS + scripts, np.int64))
                codes = code_points(text)
                begin, end, script = words(codes)
                n[BUCKETS:] += np.bincount(script, weights=end - begin, minlength=scripts).astype(np.int64)
                for part in blocks(begin, end):
                    for bucket in features(codes, begin[part], end[part]):
                        n[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)[:BUCKETS]
        for lang, n in found.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[some])], names=["lang", "slot", "n"])

    sums = map_batches(some, counted, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()  # of a bounded size
    langs = sorted(set(sums["lang"].to_pylist()), key=str.encode)
    table = np.zeros((BUCKETS + scripts, len(langs)), np.int64)
    at = {lang: i for i, lang in enumerate(langs)}
    table[sums["slot"].to_numpy(), [at[x] for x in sums["lang"].to_pylist()]] = sums["n"].to_numpy()
    return fit(langs, table[:BUCKETS], table[BUCKETS:])


def single(score: np.ndarray) -> int | None:
    """The language of all words, if no stretch of others can be worth its changes; None if that must be looked at.

    A path with k stretches of others side by side changes at least k - 1 times for them (k times at an end, k + 1 times inside).  One
    stretch over all words gains nothing, for no language has a higher sum; if no stretch gains more than half of what a change
    costs, two and more do not pay either.
    """
    best = int(score.sum(axis=0, dtype=np.int64).argmax())
    gain = np.cumsum(score - score[:, best : best + 1], axis=0, dtype=np.int64)
    low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
    low = np.concatenate([np.zeros((1, gain.shape[1]), np.int64), low[:-1]])
    return best if (gain - low).max() <= SWITCH * UNIT // 2 else None


def viterbi(scores: list[np.ndarray]) -> list[np.ndarray]:
    """The best language of each word of each text; the texts take their steps together, the longest first."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    size = np.array([len(scores[i]) for i in order])
    flat = np.concatenate([scores[i] for i in order])
    first = np.cumsum(size) - size
    total = flat[first].astype(np.int64)
    steps = []
    for t in range(1, int(size[0])):
        n = int(np.searchsorted(-size, -t))  # texts with a word here
        total = total[:n] if n < len(total) else total
        top = total.argmax(axis=1)
        best = total[np.arange(n), top] - SWITCH * UNIT
        changed = best[:, None] > total
        ends = size[:n] == t + 1
        total = np.where(changed, best[:, None], total) + flat[first[:n] + t]
        steps.append((top.astype(np.int16), changed, total[ends].argmax(axis=1) if ends.any() else None, ends))
    out = np.zeros(len(flat), np.int16)
    state = np.zeros(len(size), np.int64)
    short = size == 1
    state[short] = flat[first[short]].argmax(axis=1)
    for t in range(int(size[0]) - 1, 0, -1):
        top, changed, last, ends = steps[t - 1]
        n = len(top)
        if last is not None:
            state[:n][ends] = last
        now = state[:n]
        out[first[:n] + t] = now
        state[:n] = np.where(changed[np.arange(n), now], top, now)
    out[first] = state
    found: list[np.ndarray] = [np.zeros(0, np.int16)] * len(scores)
    for k, i in enumerate(order):
        found[i] = out[first[k] : first[k] + size[k]]
    return found


def gathered(texts: list) -> Iterator[list[str]]:
    """The texts in groups of about BLOCK characters."""
    held: list[str] = []
    size = 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def label(texts: list, model: Model) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """First character, end, number of the language and scores of each word of each text."""
    wait: list = []

    def ready() -> Iterator:
        hard = [x[3] for x in wait if x[2] is None]
        paths = iter(viterbi(hard) if hard else [])
        for begin, end, one, score in wait:
            yield begin, end, next(paths) if one is None else np.full(len(begin), one, np.int16), score
        wait.clear()

    held = 0
    for group in gathered(texts):
        codes = code_points("\0".join(group))
        begin, end, script = words(codes)
        if not model.langs:
            begin, end, script = begin[:0], end[:0], script[:0]
        score = model.score(codes, begin, end, script)
        starts = np.cumsum([0, *(len(t) + 1 for t in group)])
        for start, (a, b) in zip(starts, itertools.pairwise(np.searchsorted(begin, starts)), strict=False):
            wait.append((begin[a:b] - start, end[a:b] - start, single(score[a:b]) if b > a else 0, score[a:b]))
        held += score.size
        if held > 8 * BLOCK:
            yield from ready()
            held = 0
    yield from ready()


def judge(begin: np.ndarray, end: np.ndarray, path: np.ndarray, score: np.ndarray, langs: list[str]) -> tuple[str, float]:
    """The language with most letters, and its share of them times how clearly its words speak for it."""
    if not len(path):
        return NONE, 0.0
    letters = np.bincount(path, weights=end - begin, minlength=len(langs))
    best = int(letters.argmax())
    own = score[path == best].sum(axis=0, dtype=np.int64)
    lead = (own - own[best]) / (UNIT * np.sqrt((path == best).sum()))
    return langs[best], round(float(letters[best] / letters.sum() / np.exp(np.minimum(lead, 50)).sum()), 9)


def _labelled(docs: DataFrame, model: Model, schema: str, make) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *make(label(batch.column(1).to_pylist(), shared.value), shared.value.langs)], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *(c.split()[0] for c in schema.split(", "))]
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, {schema}")


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row, from the labels of its words."""

    def made(labels, langs: list[str]) -> list[pa.Array]:
        found = [judge(*x, langs) for x in labels]
        return [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]

    return _labelled(docs, model, "lang_pred string, score double", made)


def stretches(begin: np.ndarray, end: np.ndarray, path: np.ndarray, langs: list[str]) -> list[dict]:
    edges = [0, *(np.flatnonzero(np.diff(path)) + 1), len(path)] if len(path) else [0]
    return [{"first": int(begin[a]), "end": int(end[b - 1]), "lang": langs[path[a]]} for a, b in itertools.pairwise(edges)]


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and spans of every row: stretches of words of one language, by their first character and end (in code points)."""
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    return _labelled(docs, model, "spans array<struct<first:int,end:int,lang:string>>", lambda labels, langs: [pa.array([stretches(b, e, p, langs) for b, e, p, _ in labels], kind)])

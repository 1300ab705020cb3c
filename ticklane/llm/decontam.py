"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` turns the documents of every task into index segments (as search engines do): a segment holds the sorted
postings (term, position) of its documents, all positions of a segment on one axis with a gap between documents, and is
written to the shared folder once, whatever the number of test items.  A term is the word's XXH64.  Stored are the postings of
terms that pass a Bloom filter of the items' words, whose size is fixed (``FILTER_BITS``).  Documents are never shuffled, a
segment's size is bounded by words, and a very long document spans segments that overlap by the longest phrase, so no key or
document can make a task large.

``search`` takes the phrases of the test items in blocks of a bounded size; a long item is split into pieces that overlap.  In
a segment, the postings of each phrase's rarest term, adjusted by its offset, are candidate starts; they are intersected with
the offset-adjusted postings of the other terms, rarest first, for all phrases at once.  ``slop`` above 0 returns proximity
matches as well: they begin at an occurrence of the phrase's first word, and every other word occurs within slop words of its place, in
the same document; which words are rare only decides how they are found.  Only documents with a match leave a search.

Words are maximal runs outside ASCII punctuation and white space after A-Z is lower-cased.  Defined cases: a null or empty
text has no words; an item without words has no phrases; an item shorter than a window is one phrase; items are told apart by
their row, so repeated and null item ids count each, and a null id adds nothing to the digest; repeated document rows are
kept apart; an empty table gives an empty table; null ids are carried along; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklane.llm.shared import Scratch, map_batches, placed, rows_at, text_bytes

WINDOW = 10
#: Words of a segment, and words of the test items of a block.
SEGMENT_WORDS, BLOCK_WORDS = 500_000, 400_000
#: Bits of the filter of the items' words (16 MB), and distinct words whose terms a task remembers.
FILTER_BITS, REMEMBERED = 1 << 27, 300_000
_BREAK = frozenset([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b in _BREAK else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words by the contract `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z is lower-cased, as UTF-8."""
    return text_bytes(text).translate(_WORDS).split()


def term(word: bytes) -> int:
    """A word's term: its XXH64 as a signed long, 1 for 0, which stands for no term."""
    value = xxhash.xxh64_intdigest(word) or 1
    return value - (1 << 64) if value >> 63 else value


class WordFilter:
    """Bloom filter of terms, of a fixed size: what it holds is found, something else seldom is."""

    def __init__(self, bits: int = FILTER_BITS):
        self.mask = bits - 1
        self.bytes = np.zeros(bits // 8, np.uint8)
        self.longest = 1  # words of the longest phrase
        self.slop = 0  # how far from its place a word may lie

    def _places(self, value):
        return value & self.mask, value >> 32 & self.mask

    def add(self, value: int) -> None:
        for place in self._places(value):
            self.bytes[place >> 3] |= 1 << (place & 7)

    def holds(self, values: np.ndarray) -> np.ndarray:
        """Which terms may be in it."""
        out = np.ones(len(values), bool)
        for place in self._places(values):
            out &= (self.bytes[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
        return out


class Phrases:
    """Windows of a block of items (row number, id, words) as numbers of the block's distinct terms."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        numbers: dict[bytes, int] = {}
        found: dict[tuple, set[int]] = {}
        self.rows = [row for row, _, _ in items]
        self.ids = [None if i is None else str(i) for _, i, _ in items]
        for k, (_, _, said) in enumerate(items):
            seq = [numbers.setdefault(w, len(numbers)) for w in said]
            for s in range(max(1, len(seq) - window + 1) if seq else 0):
                found.setdefault(tuple(seq[s : s + window]), set()).add(k)
        terms = np.array([term(w) for w in numbers], np.int64)
        order = np.argsort(terms, kind="stable")
        self.terms = terms[order]  # sorted; phrases hold places in it
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.size = np.array([len(p) for p in found], np.int64)
        self.longest = int(self.size.max(initial=1))
        self.seq = np.full((len(found), self.longest), -1, np.int64)
        for r, p in enumerate(found):
            self.seq[r, : len(p)] = place[list(p)]
        self.items = [sorted(x) for x in found.values()]


class Segment:
    """Postings of some documents: term, position pairs in order of term, then position."""

    def __init__(self, terms: np.ndarray, positions: np.ndarray, vocabulary: int):
        self.first = np.searchsorted(terms, np.arange(vocabulary + 1))
        self.positions = positions
        self.span = int(positions.max(initial=0)) + 1
        self.keys = terms * self.span + positions

    def has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Is each (term, position) a posting?"""
        key = term * self.span + position
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        return (position >= 0) & (position < self.span) & (self.keys[at] == key) if len(self.keys) else np.zeros(len(key), bool)

    def near(self, term: np.ndarray, position: np.ndarray, slop: int) -> np.ndarray:
        """Does the term have a posting within slop of the position?"""
        low = np.searchsorted(self.keys, term * self.span + np.clip(position - slop, 0, self.span - 1))
        high = np.searchsorted(self.keys, term * self.span + np.clip(position + slop, 0, self.span - 1), side="right")
        return (high > low) & (position + slop >= 0)

    def begun(self, phrases: Phrases, phrase: np.ndarray, start: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """The (phrase, position) of first words within slop of the starts, each once."""
        pairs = []
        for k in range(-slop, slop + 1):
            there = self.has(phrases.seq[phrase, 0], start + k)
            pairs.append(np.stack([phrase[there], start[there] + k], axis=1))
        found = np.unique(np.concatenate(pairs), axis=0)
        return found[:, 0], found[:, 1]

    def matches(self, phrases: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start position) of every occurrence."""
        if not len(phrases.seq) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        often = np.append(np.diff(self.first), 0)
        count = np.where(phrases.seq >= 0, often[phrases.seq], np.iinfo(np.int64).max)
        order = np.argsort(count, axis=1, kind="stable")
        live = np.flatnonzero(count.min(axis=1) > 0)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        load = count[live].min(axis=1)
        for part in np.split(live, np.flatnonzero(np.diff(np.cumsum(load) // 2_000_000)) + 1) if len(live) else []:
            rare = order[part, 0]
            term = phrases.seq[part, rare]
            n = often[term]
            phrase = np.repeat(part, n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[np.repeat(self.first[term], n) + step] - np.repeat(rare, n)
            if slop:
                phrase, start = self.begun(phrases, phrase, start, slop)
            for k in range(0 if slop else 1, phrases.longest):
                if not len(phrase):
                    break
                offset = order[phrase, k]
                wanted = phrases.seq[phrase, offset]
                there = self.near(np.maximum(wanted, 0), start + offset, slop) if slop else self.has(np.maximum(wanted, 0), start + offset)
                keep = (wanted < 0) | there
                phrase, start = phrase[keep], start[keep]
            found.append((phrase, start))
        return np.concatenate([p for p, _ in found] or [np.zeros(0, np.int64)]), np.concatenate([s for _, s in found] or [np.zeros(0, np.int64)])


_SEGMENT = "docs array<struct<row:string,doc_id:{kind},first:long,words:long,base:long,lap:int>>, terms binary, positions binary"


def _packed(docs: list[dict], terms: list[np.ndarray], positions: list[np.ndarray]) -> dict:
    t = np.concatenate(terms or [np.zeros(0, np.int64)])
    p = np.concatenate(positions or [np.zeros(0, np.int64)])
    order = np.lexsort((p, t))
    return {"docs": docs, "terms": t[order].astype(np.int64).tobytes(), "positions": p[order].astype(np.int32).tobytes()}


def build_index(docs: DataFrame, wanted: WordFilter, scratch: Scratch, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Index segments of all documents (doc_id, text), written to the shared folder.

    Stored are the postings of wanted words; documents, their sizes and where they begin on the segment's axis stand beside
    them.  A document longer than a segment goes on in the next, which repeats the last words (as many as a match can reach over).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        sought = shared.value
        # words between documents, and words that parts of a document share: what a match can reach over
        gap, lap = sought.longest + sought.slop, sought.longest - 1 + 2 * sought.slop
        known: dict[bytes, int] = {}  # a word's term; 0 if it is not wanted
        row, base = 0, 0
        entries: list[dict] = []
        terms: list[np.ndarray] = []
        positions: list[np.ndarray] = []
        schema = None

        def looked_up(found: list[bytes]) -> np.ndarray:
            fresh = [w for w in dict.fromkeys(found) if w not in known]
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                fresh = list(dict.fromkeys(found))
            values = np.array([term(w) for w in fresh], np.int64)
            known.update(zip(fresh, np.where(sought.holds(values), values, 0).tolist(), strict=True))
            return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

        def flush():
            nonlocal entries, terms, positions, base
            out = pa.RecordBatch.from_pylist([_packed(entries, terms, positions)], schema=schema)
            entries, terms, positions, base = [], [], [], 0
            return out

        for batch in batches:
            schema = schema or pa.schema([
                ("docs", pa.list_(pa.struct([("row", pa.string()), ("doc_id", batch.column(0).type), ("first", pa.int64()), ("words", pa.int64()), ("base", pa.int64()), ("lap", pa.int32())]))),
                ("terms", pa.binary()), ("positions", pa.binary())])
            ids = batch.column(0).to_pylist()
            for k, text in enumerate(batch.column(1).to_pylist()):
                seq = looked_up(words(text))
                row += 1
                first = 0
                while True:
                    room = max(segment_words - base, 2 * (lap + 1))
                    last = min(len(seq), first + room)
                    at = np.flatnonzero(seq[first:last])
                    entries.append({"row": f"{part}-{row}", "doc_id": ids[k], "first": first, "words": len(seq), "base": base, "lap": last - first})
                    terms.append(seq[first:last][at])
                    positions.append(at + base)
                    base += last - first + gap
                    if base >= segment_words:
                        yield flush()
                    if last == len(seq):
                        break
                    first = last - lap
        if entries:
            yield flush()

    return scratch.cut(map_batches(docs.select("doc_id", "text"), segments, _SEGMENT.format(kind=kind)))


_HIT = "row string, spans array<long>, items array<struct<item:long,id:string>>"


def search(index: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """For each document part of the index with a match: row, spans (starts and ends of hit words, merged), items (row number, id)."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = shared.value
        named = [{"item": r, "id": i} for r, i in zip(sought.rows, sought.ids, strict=True)]
        schema = pa.schema([("row", pa.string()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.struct([("item", pa.int64()), ("id", pa.string())])))])
        for batch in batches:
            for k in range(batch.num_rows):
                t = np.frombuffer(batch.column(1)[k].as_py(), np.int64)
                p = np.frombuffer(batch.column(2)[k].as_py(), np.int32).astype(np.int64)
                at = np.searchsorted(sought.terms, t)
                there = (at < len(sought.terms)) & (sought.terms[np.minimum(at, max(0, len(sought.terms) - 1))] == t) if len(sought.terms) else np.zeros(len(t), bool)
                phrase, start = Segment(at[there], p[there], len(sought.terms)).matches(sought, slop)
                if not len(start):
                    continue
                docs = batch.column(0)[k].as_py()
                bases = np.array([d["base"] for d in docs], np.int64)
                owner = np.searchsorted(bases, start, side="right") - 1
                order = np.lexsort((start, owner))
                phrase, start, owner = phrase[order], start[order], owner[order]
                out = []
                for o in np.unique(owner):
                    d, (lo, hi) = docs[o], np.searchsorted(owner, [o, o + 1])
                    begin = start[lo:hi] - d["base"] + d["first"]
                    spans = _merged(np.maximum(begin, 0), np.minimum(begin + sought.size[phrase[lo:hi]], d["words"]))
                    items = {i for q in np.unique(phrase[lo:hi]) for i in sought.items[q]}
                    out.append({"row": d["row"], "spans": spans, "items": [named[i] for i in sorted(items)]})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return map_batches(index.select("docs", "terms", "positions"), looked_up, _HIT)


def _merged(begin: np.ndarray, end: np.ndarray) -> list[int]:
    """Start, end, start, end ... of the union of intervals; begin in order."""
    if not len(begin):
        return []
    reach = np.maximum.accumulate(end)
    new = np.flatnonzero(np.append(True, begin[1:] > reach[:-1]))
    return np.stack([begin[new], reach[np.append(new[1:], len(begin)) - 1]], axis=1).ravel().tolist()


def item_blocks(items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple]]:
    """(row number, id, words) of the test items in blocks of a bounded number of words, one block on the driver at a time.

    An item longer than a block is split into pieces that overlap by a window less a word, so no window is lost.
    """
    block, load = [], 0
    for number, row in enumerate(items.select("item_id", "text").toLocalIterator()):
        said = words(row.text)
        step = max(block_words, window)
        for low in range(0, max(1, len(said) - window + 1), step):
            piece = said[low : low + step + window - 1]
            if block and load + len(piece) > block_words:
                yield block
                block, load = [], 0
            block.append((number, row.item_id, piece))
            load += len(piece)
    if block:
        yield block


def _indexed(docs: DataFrame, items: DataFrame, scratch: Scratch, window: int, slop: int, segment_words: int, block_words: int) -> tuple[DataFrame, DataFrame]:
    """The index of docs and the hits (row, spans, items) of all items, a row for each part and block."""
    items = scratch.cut(items.select("item_id", "text"))  # read twice, in one order
    wanted = WordFilter()
    wanted.slop = slop
    for block in item_blocks(items, window, block_words):
        for _, _, said in block:
            wanted.longest = max(wanted.longest, min(window, len(said)))
            for word in set(said):
                wanted.add(term(word))
    index = build_index(docs, wanted, scratch, segment_words)
    hits = docs.sparkSession.createDataFrame([], _HIT)
    for block in item_blocks(items, window, block_words):
        hits = hits.unionByName(search(index, Phrases(block, window), slop))
    return index, hits


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0, segment_words: int = SEGMENT_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, spans, item_ids (strings, in order; null ids left out) of every document row."""
    scratch = Scratch(docs.sparkSession, "index")
    index, hits = _indexed(docs, items, scratch, window, slop, segment_words, block_words)
    each = index.select(F.explode("docs").alias("d")).where("d.first = 0").select("d.row", "d.doc_id", F.col("d.words").alias("n_words"))
    return _summed(each, hits)


def _summed(each: DataFrame, hits: DataFrame) -> DataFrame:
    """Every document with its hits put together; only those that were hit are gathered."""
    whole = hits.groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, hit = [], []
            for flat in batch.column(1).to_pylist():
                pairs = np.array(flat, np.int64).reshape(-1, 2)
                pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
                spans.append(_merged(pairs[:, 0], pairs[:, 1]))
                hit.append(sum(spans[-1][1::2]) - sum(spans[-1][::2]))
            items = batch.column(2).to_pylist()
            ids = [sorted(i["id"] for i in x if i["id"] is not None) for x in items]
            digests = [hashlib.sha256(",".join(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]
            columns = [batch.column(0), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests), pa.array(spans, pa.list_(pa.int64())), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n_hit", "n_items", "items_sha256", "spans", "item_ids"])

    found = map_batches(whole, finished, "row string, n_hit long, n_items long, items_sha256 string, spans array<long>, item_ids array<string>")
    joined = each.join(found, "row", "left")
    empty = lambda c, value: F.coalesce(F.col(c), value).alias(c)
    return joined.select(
        "doc_id", "n_words", empty("n_hit", F.lit(0).cast("long")), empty("n_items", F.lit(0).cast("long")), empty("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())),
        empty("spans", F.array().cast("array<long>")), empty("item_ids", F.array().cast("array<string>")))


def keep_uncontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, segment_words: int = SEGMENT_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns as they are, in which no window of an item occurs. Rows are known by their place, not by id."""
    scratch = Scratch(docs.sparkSession, "clean")
    docs, place = placed(docs, scratch)
    keyed = docs.select("text", *place).select(F.struct("_file", "_line").alias("doc_id"), "text")
    index, hits = _indexed(keyed, items, scratch, window, 0, segment_words, block_words)
    each = index.select(F.explode("docs").alias("d")).select("d.row", "d.doc_id")
    dirty = scratch.cut(each.join(hits.select("row").distinct(), "row", "left_semi").select("doc_id.*").distinct())
    return rows_at(docs, place, dirty, "left_anti")

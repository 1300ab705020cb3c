"""Source divergence audit: how far each source of a group departs, in its choice of terms, from its group and from the other sources.

Tasks count terms (bytes in, dictionaries of bounded size out) and deal the counts to buckets of a lang's terms, a row a bucket.
A bucket is encoded where it arrives: the terms that enough documents have become a sorted array, counts get their terms' numbers by
``searchsorted`` and sources get dense vectors by ``bincount``.  Numbers follow UTF-8 order, so the vectors of a chunk line up and ties
need no text.  A chunk is a bucket, or a part of one of ``CHUNK`` terms and ``CELLS`` counts at most; there are ``BUCKETS_EACH`` buckets a lang
for each shuffle partition, so they grow with what the session is set up for.  Shares and divergences are whole numbers throughout.

Defined cases: null text, lang and source count as empty; a source without any kept term still has its smoothed shares and all its
pairs; a lang without kept terms has pairs of value 0; repeated rows and ids are documents of their own; ties are ordered by UTF-8
bytes; texts of any length are read whole; an empty table gives an empty result; other columns are never read.  What a lang's
sources sum up to (a name and a count each) travels beside its chunks, as the result has a row for each pair of them anyhow.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklane.llm.shared import Scratch, join_totals, map_batches, text_bytes

LEAST_DOCS, MOST_TERMS, SCALE, SMOOTH = 3, 200, 1_000_000_000, 1
CHUNK, CELLS, BUCKETS_EACH = 16_384, 1 << 19, 4
#: Distinct terms that a task counts before it sends them on; sums of pairs that it holds.
MOST_COUNTED, MOST_PAIRS = 1_000_000, 1 << 20

# Letters, lower-cased where they are A-Z, and all bytes above 7F stay; the rest separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("terms", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("n", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
CHUNKS = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.string())), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("totals", pa.list_(pa.int64()))])
FOUND = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def ddl(schema: pa.Schema) -> str:
    kind = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long"}
    return ", ".join(f"{f.name} {f'array<{kind[f.type.value_type]}>' if pa.types.is_list(f.type) else kind[f.type]}" for f in schema)


def terms(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(_FOLD).split()


def _dealt(tally: dict, buckets: int) -> Iterator[pa.RecordBatch]:
    """Rows of COUNTS of what a task has counted: one a lang and bucket."""
    langs: dict[str, list] = {}
    for (lang, source), found in tally.items():
        langs.setdefault(lang, []).append((source, *found))
    for lang, found in langs.items():
        names, words, n, docs = [], [], [], []
        for source, often, seen in found:
            if often:
                names.append((source, len(often)))
                words += often
                n += often.values()
                docs += map(seen.__getitem__, often)
        if not words:
            continue
        bucket = np.fromiter(map(crc32, words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        owner = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(names), dtype=np.int32), [k for _, k in names])), pa.array([x for x, _ in names], pa.string()))
        rows, first = np.unique(bucket[order], return_index=True)
        offsets = pa.array(np.append(first, len(order)), pa.int32())
        columns = [pa.array(words, pa.binary()).cast(pa.string()), owner.cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
        lists = [pa.ListArray.from_arrays(offsets, c.take(pa.array(order))) for c in columns]
        made = pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(rows, pa.int32()), *lists], schema=COUNTS)
        for low in range(0, len(rows), 64):
            yield made.slice(low, 64)


def count_terms(docs: DataFrame, buckets: int) -> DataFrame:
    """COUNTS: occurrences and documents of each term and source, summed for each task, a row a lang and bucket of terms."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, seen = tally.setdefault((lang or "", source or ""), (Counter(), Counter()))
                words = terms(text)
                n.update(words)
                seen.update(set(words))
            if sum(len(n) + 1 for n, _ in tally.values()) > MOST_COUNTED:
                yield from _dealt(tally, buckets)
                tally.clear()
        yield from _dealt(tally, buckets)

    return map_batches(docs.select("lang", "source", "text"), counted, ddl(COUNTS))


def merged(rows: pa.Table) -> pa.Table:
    """term, source, n, docs: one row for each term and source of rows of COUNTS, sorted by term."""
    flat = [pa.chunked_array([x.flatten() for x in rows[c].chunks], type=rows.schema.field(c).type.value_type).combine_chunks() for c in ("terms", "sources", "n", "docs")]
    term, source = (x.dictionary_encode() for x in flat[:2])
    order = pc.array_sort_indices(term.dictionary).to_numpy()  # UTF-8 order
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    width = max(1, len(source.dictionary))
    cell, where = np.unique(place[term.indices.to_numpy()] * width + source.indices.to_numpy(), return_inverse=True)
    sums = []
    for x in flat[2:]:
        total = np.zeros(len(cell), np.int64)
        np.add.at(total, where, x.to_numpy())  # a bincount whose weights are whole numbers
        sums.append(pa.array(total))
    return pa.table([term.dictionary.take(pa.array(order[cell // width])), source.dictionary.take(pa.array(cell % width)), *sums], names=["term", "source", "n", "docs"])


def encode(lang: str, rows: pa.Table, least_docs: int = LEAST_DOCS) -> Iterator[pa.RecordBatch]:
    """CHUNKS of what merged() made of one bucket."""
    term, source = (rows[c].combine_chunks().dictionary_encode() for c in ("term", "source"))
    run = term.indices.to_numpy()  # ascending: rows are sorted by term
    n, docs = rows["n"].to_numpy(), rows["docs"].to_numpy()
    edges = np.searchsorted(run, np.arange(len(term.dictionary)))
    kept = np.flatnonzero(np.add.reduceat(docs, edges) >= least_docs) if len(run) else np.zeros(0, np.int64)  # the sorted array of kept terms
    names = pc.array_sort_indices(source.dictionary).to_numpy()
    place = np.empty(max(1, len(names)), np.int64)
    place[names] = np.arange(len(names))
    owner = place[source.indices.to_numpy()] if len(run) else run
    texts, width = term.dictionary, max(1, min(CHUNK, CELLS // max(1, len(names))))
    for low in range(0, len(kept), width):
        part = kept[low : low + width]
        inside = slice(np.searchsorted(run, part[0]), np.searchsorted(run, part[-1], side="right"))
        ids = np.searchsorted(part, run[inside])
        hit = part[ids] == run[inside]
        counts = np.zeros((len(names), len(part)), np.int64)
        counts[owner[inside][hit], ids[hit]] = n[inside][hit]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang], pa.string()), *(pa.array([x], t) for x, t in (
                (texts.take(pa.array(part)).to_pylist(), pa.list_(pa.string())), (source.dictionary.take(pa.array(names)).to_pylist(), pa.list_(pa.string())),
                (counts.ravel(), pa.list_(pa.int64())), (counts.sum(axis=1), pa.list_(pa.int64()))))], schema=CHUNKS)


def chunks(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """CHUNKS of count_terms(): for each the kept terms in UTF-8 order, the sources that have any of the bucket's, their counts (source by
    source, a row of the matrix each) and their sums."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0

        def whole() -> pa.Table:
            return merged(pa.Table.from_batches(held, COUNTS))

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for low, high in itertools.pairwise(edges):
                if high == low:
                    continue
                if keys[low] != key and held:
                    yield from encode(key[0], whole(), least_docs)
                    held, size = [], 0
                key = keys[low]
                part = batch.slice(low, high - low)
                held.append(part)
                size += pc.sum(pc.list_value_length(part.column(2))).as_py()
                if size > 2 * CELLS:  # as many rows as the bucket has terms and sources go on
                    rows = whole()
                    lists = [pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows[c].combine_chunks()) for c in rows.column_names]
                    held, size = [pa.RecordBatch.from_arrays([pa.array([key[0]], pa.string()), pa.array([key[1]], pa.int32()), *lists], schema=COUNTS)], 0
        if held:
            yield from encode(key[0], whole(), least_docs)

    return counts.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket").mapInArrow(encoded, ddl(CHUNKS))


def shares(counts: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(SCALE * (counts + SMOOTH) / total), for counts + SMOOTH <= total < 9e15, by long division in steps of 1000."""
    rest = counts + SMOOTH
    out = np.zeros(rest.shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


@dataclass
class Tally:
    """What a task has found of one lang: sums of pairs, and for each source the most telling terms with their values."""

    names: list[str]
    pairs: np.ndarray
    tops: list[tuple[np.ndarray, list[str]]]

    def add(self, chunk: dict, most_terms: int) -> None:
        size, kept, total = len(chunk["terms"]), chunk["kept"], np.array([g["n"] for g in chunk["groups"]], np.int64)
        if not size:
            return
        counts = np.zeros((len(self.names), size), np.int64)
        at = {x: i for i, x in enumerate(self.names)}
        counts[[at[x] for x in chunk["sources"]]] = chunk["counts"].reshape(-1, size)
        p = np.array([shares(row, n + SMOOTH * kept) for row, n in zip(counts, total, strict=True)])
        q = shares(counts.sum(axis=0), int(total.sum()) + SMOOTH * kept)
        for i in range(len(p)):
            self.pairs[i] += squares(p[i], p).sum(axis=1)
            telling = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            f = squares(p[i][telling], q[telling])
            best = np.lexsort((telling, -f))[:most_terms]
            values, items = self.tops[i]
            values, items = np.concatenate([values, f[best]]), [*items, *(chunk["terms"][j] for j in telling[best])]
            if len(items) > 2 * most_terms:
                order = sorted(range(len(items)), key=lambda j: (-values[j], items[j].encode()))[:most_terms]
                values, items = values[order], [items[j] for j in order]
            self.tops[i] = values, items

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        for i, name in enumerate(self.names):
            others = [j for j in range(len(self.names)) if j != i]
            for part, items, values in (("pair", [self.names[j] for j in others], self.pairs[i][others]), ("term", self.tops[i][1], self.tops[i][0])):
                if len(items):
                    yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(items), pa.string()) for x in (lang, name, part)), pa.array(items, pa.string()), pa.array(values, pa.int64())], schema=FOUND)


def compare(found: DataFrame, most_terms: int) -> DataFrame:
    """FOUND, summed for each task, of chunks with their lang's groups and number of kept terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Tally] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                chunk = {n: batch.column(k)[i].values.to_numpy() if n == "counts" else batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                if chunk["lang"] not in tallies:
                    names = [g["source"] for g in chunk["groups"]]
                    if sum(t.pairs.size for t in tallies.values()) + len(names) ** 2 > MOST_PAIRS:
                        for lang, tally in tallies.items():
                            yield from tally.rows(lang)
                        tallies.clear()
                    tallies[chunk["lang"]] = Tally(names, np.zeros((len(names), len(names)), np.int64), [(np.zeros(0, np.int64), []) for _ in names])
                tallies[chunk["lang"]].add(chunk, most_terms)
        for lang, tally in tallies.items():
            yield from tally.rows(lang)

    return map_batches(found, run, ddl(FOUND))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most_terms: int = MOST_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank of each source of each lang."""
    scratch = Scratch(docs.sparkSession, "divergence")
    buckets = BUCKETS_EACH * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = scratch.cut(chunks(count_terms(docs, buckets), least_docs))
    sums = made.select("lang", F.inline(F.arrays_zip("sources", "totals"))).groupBy("lang", F.col("sources").alias("source")).agg(F.sum("totals").alias("n"))
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = named.join(sums, ["lang", "source"], "left").fillna(0, ["n"])
    sizes = made.groupBy("lang").agg(F.sum(F.size("terms")).alias("kept"), F.count(F.lit(1)).alias("size"))
    groups = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "n"))).alias("groups"))
    # a chunk without terms for each lang: its pairs exist even if nothing is kept
    totals = scratch.cut(groups.join(sizes, "lang", "left").select("lang", "groups", F.coalesce("kept", F.lit(0)).alias("kept"), (F.coalesce("size", F.lit(0)) + 1).alias("size")))
    none = totals.select("lang", *[F.expr(f"cast(array() as {kind})").alias(n) for n, kind in (("terms", "array<string>"), ("sources", "array<string>"), ("counts", "array<long>"))])
    rows = scratch.cut(made.drop("totals").unionByName(none))
    found = scratch.cut(compare(join_totals(rows, totals, ["lang"], "size", rows.count()).select("lang", "terms", "sources", "counts", "groups", "kept"), most_terms))
    line = W.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    tops = found.where("part = 'term'").withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= most_terms)
    return pairs.withColumn("rank", F.row_number().over(line)).unionByName(tops)

"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint takes bit i where over half of its shingles' XXH64 hashes have it.  Equal fingerprints are one
fingerprint from there on.  Distinct fingerprints are cut into segments; if two differ in at most ``reach`` bits, they
differ in at most reach // m bits of one of the first reach % m + 1 segments, or in fewer in one of the others.  Every
fingerprint is filed in a table under each segment's value, and looks up the values of the small Hamming ball around its
own value (only those with a bit set that it lacks: of two values that differ in a bit, one finds the other).  Matches
are verified on the whole fingerprint.

Where a table entry holds many fingerprints, its members and its visitors are dealt to blocks of about ``BLOCK``, and pairs
of blocks are named by numbers, joined with either end by that block's own key and compared in tasks of their own, so no group
is gathered whole; a pair of blocks returns a spanning forest of its links, not all pairs, which keeps every component and
bounds what is written.  Components come from components().  Joins with a total of a group leave a hot group's rows where they
are (join_totals).

Defined cases: a null or empty text has no words and fingerprint zero, which links like any other; fewer words than a
shingle are one shingle; rows with a null doc_id are linked but never name a component (null if all ids are null); repeated
rows fall together; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.llm.components import components
from ticklane.llm.shared import ASCII_LOWER, Scratch, join_totals, map_batches, placed, rows_at, text_bytes

SHINGLE = 4
REACH = 4
SEGMENTS = 3
SEED = 42
BLOCK = 2048


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of a whole text, unsigned."""
    import xxhash

    found = text_bytes(text).translate(ASCII_LOWER).split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[: max(0, len(found) - width)].tolist()]
    stops = (ends[min(width, len(found)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    total = len(stops)
    for low in range(0, total, 65_536):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[low : low + 65_536], stops[low : low + 65_536], strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long) of every row."""

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return map_batches(docs.select("doc_id", "text"), printed, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def segment_bits(segments: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each segment."""
    sizes = [64 // segments + (i < 64 % segments) for i in range(segments)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def radius(segment: int, segments: int, reach: int) -> int:
    """Bits in which the values of a segment may differ."""
    return reach // segments - (segment > reach % segments)


def _value(first: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.col("fp"), first).bitwiseAND(F.lit((1 << bits) - 1))


def filed(prints: DataFrame, segments: int, reach: int) -> DataFrame:
    """seg, key, fp: a row for each table."""
    rows = [F.struct(F.lit(i).alias("seg"), _value(*b).alias("key")) for i, b in enumerate(segment_bits(segments)) if radius(i, segments, reach) >= 0]
    return prints.select("fp", F.explode(F.array(*rows)).alias("t")).select("t.seg", "t.key", "fp")


def visits(prints: DataFrame, segments: int, reach: int) -> DataFrame:
    """seg, key, fp: the values around a fingerprint's own, from the half of the ball that has the highest flipped bit set."""
    out = []
    for i, (first, bits) in enumerate(segment_bits(segments)):
        flips = [sum(1 << b for b in c) for r in range(1, radius(i, segments, reach) + 1) for c in combinations(range(bits), r)]
        if flips:
            own = _value(first, bits)
            keys = F.transform(F.filter(F.array(*[F.lit(f).cast("long") for f in flips]), lambda f: own.bitwiseXOR(f) > own), lambda f: own.bitwiseXOR(f))
            out.append(prints.select(F.lit(i).alias("seg"), F.explode(keys).alias("key"), "fp"))
    none = prints.select(F.lit(0).alias("seg"), F.col("fp").alias("key"), "fp").where(F.lit(False))
    return reduce(DataFrame.unionByName, out) if out else none


#: Pairs of fingerprints that are compared at once.
AT_ONCE = 1 << 20


def _forest(left: np.ndarray, right: np.ndarray, reach: int) -> np.ndarray:
    """Spanning forest, as pairs, of the links between two blocks (a block with itself: within it)."""
    nodes, inverse = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = inverse[: len(left)], inverse[len(left) :]
    root, kept = np.arange(len(nodes)), []
    step = max(1, AT_ONCE // max(1, len(right)))
    for low in range(0, len(left), step):
        i, j = np.nonzero(np.bitwise_count(left[low : low + step, None] ^ right[None, :]) <= reach)
        i, j = a[low + i], b[j]
        while True:  # each root hooks once onto a smaller one by a link of its tree, then paths are shortened
            high, small = np.maximum(root[i], root[j]), np.minimum(root[i], root[j])
            open_ = high != small
            if not open_.any():
                break
            i, j, high, small = i[open_], j[open_], high[open_], small[open_]
            order = np.lexsort((small, high))
            first = order[np.flatnonzero(np.append(True, np.diff(high[order]) > 0))]
            root[high[first]] = small[first]
            kept.append(np.stack([nodes[i[first]], nodes[j[first]]], axis=1))
            while (root[root] != root).any():
                root = root[root]
    return np.concatenate(kept or [np.zeros((0, 2), nodes.dtype)])


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and where each row's begin; the last place is the end."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.append(0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False)))


def _single_links(left: pa.Array, right: pa.Array, reach: int) -> Iterator[np.ndarray]:
    """Links of each row's two lists of fingerprints: all of them where the lists are short, else a spanning forest."""
    (x, x0), (y, y0) = _lists(left), _lists(right)
    nx, ny = np.diff(x0), np.diff(y0)
    small = np.flatnonzero(nx * ny <= 64)
    for low in range(0, len(small), AT_ONCE // 64):
        rows = small[low : low + AT_ONCE // 64]
        size = nx[rows] * ny[rows]
        row = np.repeat(rows, size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        p, q = x[x0[row] + at // np.maximum(ny[row], 1)], y[y0[row] + at % np.maximum(ny[row], 1)]
        near = (np.bitwise_count((p ^ q).view(np.uint64)) <= reach) & (p != q)
        yield np.stack([p[near], q[near]], axis=1)
    for k in np.flatnonzero(nx * ny > 64):
        yield _forest(x[x0[k] : x0[k + 1]].view(np.uint64), y[y0[k] : y0[k + 1]].view(np.uint64), reach).view(np.int64)


def links(prints: DataFrame, scratch: Scratch, segments: int = SEGMENTS, reach: int = REACH, block: int = BLOCK) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that differ in at most reach bits.

    All links of small entries and a spanning forest of those of each larger pair of blocks: enough for every component.
    """
    own = filed(prints, segments, reach)
    found = visits(prints, segments, reach).join(own.select("seg", "key").distinct(), ["seg", "key"], "left_semi").withColumn("side", F.lit(1))
    rows = scratch.cut(own.withColumn("side", F.lit(0)).unionByName(found))
    counts = rows.groupBy("seg", "key").agg(F.sum(1 - F.col("side")).alias("members"), F.sum("side").alias("guests"), F.count(F.lit(1)).alias("n"))
    counts = scratch.cut(counts.where("n > 1 AND members > 0"))
    rows = scratch.cut(join_totals(rows, counts, ["seg", "key"], "n", rows.count()).drop("n"))
    large = (F.col("members") > block) | (F.col("guests") > block)
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("fp")))
    light = rows.where(~large).groupBy("seg", "key").agg(of(0).alias("fps"), of(1).alias("fps2")).select("fps", F.concat("fps", "fps2").alias("fps2"))

    size = F.when(F.col("side") == 0, F.col("members")).otherwise(F.col("guests"))
    dealt = rows.where(large).withColumns({"part": F.pmod(F.xxhash64("fp"), F.ceil(size / block)).cast("int"), "own": F.ceil(F.col("members") / block).cast("int"), "far": F.ceil(F.col("guests") / block).cast("int")})
    blocks = scratch.cut(dealt.groupBy("seg", "key", "side", "part").agg(F.collect_list("fp").alias("fps"), F.first("own").alias("own"), F.first("far").alias("far")))
    members = blocks.where("side = 0")
    many = lambda low, high, side: F.when(low < high, F.transform(F.sequence(low, high - 1), lambda x: F.struct(F.lit(side).alias("side"), x.alias("other")))).otherwise(F.array().cast("array<struct<side:int,other:int>>"))
    # which block meets which is said in numbers first; each end is then joined by a key of its own
    meets = members.select("seg", "key", "part", F.explode(F.concat(many(F.col("part"), F.col("own"), 0), many(F.lit(0), F.col("far"), 1))).alias("t")).select("seg", "key", "part", "t.side", "t.other")
    heavy = meets.join(blocks.select("seg", "key", "side", F.col("part").alias("other"), F.col("fps").alias("fps2")), ["seg", "key", "side", "other"])
    heavy = heavy.join(members.select("seg", "key", "part", "fps"), ["seg", "key", "part"]).select("fps", "fps2")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for got in _single_links(batch.column(0), batch.column(1), reach):
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    out = map_batches(light.unionByName(heavy), linked, "a long, b long")
    return out.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, segments: int | None = None, reach: int = REACH, width: int = SHINGLE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    each = scratch.cut(fingerprints(docs, width, seed))
    return _classes(each, scratch, segments, reach, block).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def segments_for(prints: int, block: int = BLOCK) -> int:
    """How many segments to cut so many distinct fingerprints into: three while a table entry holds a block of them at most on
    average, then two, with longer keys and larger balls.  Links are the same with any number."""
    return SEGMENTS if prints <= block << (64 // SEGMENTS) else 2


def _classes(each: DataFrame, scratch: Scratch, segments: int | None, reach: int, block: int) -> DataFrame:
    """each with root (a component's least fingerprint, its own alone) and component_id (its least id, which may be null or repeated)."""
    prints = scratch.cut(each.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")))
    rows, distinct = prints.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()
    roots = components(links(prints.select("fp"), scratch, segments or segments_for(distinct, block), reach, block), scratch)
    rooted = scratch.cut(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")))
    names = scratch.cut(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints")))
    named = scratch.cut(join_totals(rooted.select("fp", "rows", "root"), names, ["root"], "prints", distinct).drop("prints"))
    return join_totals(each, named, ["fp"], "rows", rows).drop("rows")


def keep_one(docs: DataFrame, segments: int | None = None, reach: int = REACH, width: int = SHINGLE, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """Rows of docs, all columns as they are: one document of each group, the one with the smallest doc_id.

    Groups are found and survivors chosen on numbers alone; a row is known by its file and its number there, since ids may
    be null or repeated.  Whole rows move once, to meet the survivors' numbers in a hash join, and are never sorted.  Of
    several rows with the least id the text with the least hash stays, of equal texts the first by place; null ids come last.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    docs, place = placed(docs, scratch)
    kind = docs.schema["doc_id"].dataType.simpleString()
    whole = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, width, seed) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=["doc_id", "fp", "whole", "_file", "_line"])

    rows = docs.select("doc_id", "text", whole.alias("whole"), *place)
    each = scratch.cut(map_batches(rows, printed, f"doc_id {kind}, fp long, whole long, _file long, _line long"))
    named = _classes(each, scratch, segments, reach, block)
    first = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "whole", "_file", "_line")).alias("first"))
    chosen = scratch.cut(first.select(F.col("first._file").alias("_file"), F.col("first._line").alias("_line")))
    return rows_at(docs, place, chosen, "left_semi")

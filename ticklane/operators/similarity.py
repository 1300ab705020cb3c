"""Windows of bars that look like given ones."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ticklane.functions.base import div, lag, w
from ticklane.operators.metrics import unit_repair
from ticklane.sources.scratch import scratch_path, written

PRICES = ("open", "high", "low", "close", "preclose")


def repaired(bars: DataFrame) -> DataFrame:
    """bars with turnover and pct_chg as shares: a column in percent (a value over 1.5) is divided by 100; an absent turnover is 0,
    an absent change comes from close and preclose."""
    if "turnover" not in bars.columns:
        bars = bars.withColumn("turnover", F.lit(0.0))
    if "pct_chg" not in bars.columns:
        bars = bars.withColumn("pct_chg", F.coalesce(div("close", "preclose") - 1, F.lit(0.0)))
        return unit_repair(bars, "turnover")
    return unit_repair(unit_repair(bars, "turnover"), "pct_chg")


def window_vectors(bars: DataFrame, length: int = 7, horizon: int = 5, recent_days: int | None = None) -> DataFrame:
    """code, start_date, end_date, vec (prices over the window's first close, turnover, change), future_days.

    A first close of 0 counts as 1.  recent_days: only windows that end within so many days of the last date of all.
    """
    back = lambda x, k: lag(x, length - 1 - k) if k < length - 1 else F.col(x)  # noqa: E731 - the window's k-th row
    rows = {f"_{x}{k}": back(x, k) for x in (*PRICES, "turnover", "pct_chg") for k in range(length)}
    df = repaired(bars).withColumns({**rows, "_start": back("date", 0), "_left": F.count(F.lit(1)).over(w().rowsBetween(1, horizon)), "_k": F.row_number().over(w())}).where(F.col("_k") >= length)
    if recent_days:
        last = bars.agg(F.date_sub(F.max("date"), recent_days).alias("_cut"))  # one row
        df = df.join(F.broadcast(last), F.col("date") >= F.col("_cut")).drop("_cut")
    first = F.when(F.col("_close0") == 0, 1.0).otherwise(F.col("_close0"))
    cells = [F.col(f"_{x}{k}") / first for x in PRICES for k in range(length)] + [F.col(f"_{x}{k}") for x in ("turnover", "pct_chg") for k in range(length)]
    return df.select("code", F.col("_start").alias("start_date"), F.col("date").alias("end_date"), F.array(*cells).alias("vec"), F.col("_left").alias("future_days"))


def asof(rows: DataFrame, targets: DataFrame, by: str = "code", on: str = "date", at: str = "target_date") -> DataFrame:
    """For each target (by, at), the last row with on <= at: an equi join on the key and a maximum, which is combined before the shuffle."""
    others = [x for x in rows.columns if x not in (by, on)]
    found = rows.join(targets, by).where(F.col(on) <= F.col(at)).groupBy(by, at).agg(F.max_by(F.struct(on, *others), on).alias("_last"))
    return targets.join(found, [by, at], "left").select(by, at, F.col(f"_last.{on}").alias(on), *[F.col(f"_last.{x}").alias(x) for x in others])


#: Targets that are searched for at a time, cells of the index each way, windows that are skipped or looked at together.
TARGETS, CELLS, BLOCK = 200, 16, 256
#: Windows that directions and cuts are fitted on, and directions that a sketch keeps.
SAMPLE, DIRECTIONS = 20_000, 12
NEAR = "target int, code {code}, start_date date, end_date date, low double, high double"
KEYS = ["code", "start_date", "end_date"]
#: Windows of the nearest cell that are measured first, for each one that is asked for.
FIRST = 8
#: Windows whose vectors are fetched at a time by broadcasting their keys.
FETCHED = 1_000_000


def directions(vectors: np.ndarray) -> np.ndarray:
    """Orthonormal directions (columns) in which a sample of vectors varies most."""
    off = vectors - vectors.mean(axis=0)
    values, found = np.linalg.eigh(off.T @ off)
    return np.ascontiguousarray(found[:, np.argsort(-values, kind="stable")[:DIRECTIONS]])


def sketch(vectors: np.ndarray, along: np.ndarray) -> np.ndarray:
    """The coordinates along the directions and the length of what is left.  Distances of sketches never exceed those of the vectors,
    whatever the directions: what is left of two vectors differs by the difference of its lengths at least."""
    inside = vectors @ along
    rest = vectors - inside @ along.T
    return np.column_stack([inside, np.sqrt((rest * rest).sum(axis=1))])


def _rows(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; a row with a missing value, or of another length than the first, is NaN."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return np.zeros((0, 0))
    if column.null_count == 0 and (sizes == sizes[0]).all():
        return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), -1)
    rows = column.to_pylist()
    width = next((len(r) for r in rows if r), 0)
    return np.array([[np.nan if v is None else v for v in r] if r is not None and len(r) == width else [np.nan] * width for r in rows], float)


def _unpacked(column: pa.Array) -> np.ndarray:
    """Doubles that were packed as bytes, a row each."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows)).reshape(len(rows), -1) if rows else np.zeros((0, 1))


@dataclass
class WindowIndex:
    """Windows by cell: a table of keys and sketches in folders of cells, the windows themselves (``source``, where vectors lie once), the
    directions of the sketches, and each cell's box of sketches (a row a cell, on the driver: CELLS^2 at most)."""

    table: DataFrame
    source: DataFrame
    along: np.ndarray
    cells: list[int]
    low: np.ndarray
    high: np.ndarray


def build_index(vectors: DataFrame, stored: bool = False) -> WindowIndex:
    """Index of windows (code, start_date, end_date, vec, future_days).  Windows with a missing value are left out.

    Directions and cuts are fitted on about SAMPLE windows (they decide how much is passed over, never what is found).  Every window is
    dealt to a cell of the two directions that vary most; cells with many windows are split over files.  It serves any number of searches.
    stored: vectors is a table that may be read twice.
    """
    spark = vectors.sparkSession
    names = ["code", "start_date", "end_date", "vec", "future_days"]
    rows = vectors.select(*names) if stored else written(vectors.select(*names), "windows")
    count = rows.count()
    chosen = F.pmod(F.xxhash64("code", "end_date"), F.lit(1 << 20)) < F.lit(int((1 << 20) * min(1.0, SAMPLE / max(count, 1))))
    some = _rows(rows.where(chosen).select("vec").toArrow()["vec"].combine_chunks())
    some = some[np.isfinite(some).all(axis=1)] if some.size else some
    if not len(some):  # few windows or none: one cell, any directions
        first = rows.where("vec IS NOT NULL").select(F.size("vec").alias("n")).first()
        some = np.zeros((1, first.n if first else 1))
    along = directions(some)
    cuts = [np.unique(np.quantile(x, np.arange(1, CELLS) / CELLS)) for x in sketch(some, along).T[:2]]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _rows(b.column(3))
            ok = np.isfinite(v).all(axis=1) if v.shape[1:] == along.shape[:1] else np.zeros(len(v), bool)
            if ok.any():
                s = sketch(v[ok], along)
                cell = sum(np.searchsorted(cut, s[:, k]) * CELLS**k for k, cut in enumerate(cuts))
                kept = b.filter(pa.array(ok))
                packed = pa.array([x.tobytes() for x in s], pa.binary())
                yield pa.RecordBatch.from_arrays([*(kept.column(n) for n in KEYS), packed, pa.array(cell, pa.int32()), pa.array(s[:, -1])], names=[*KEYS, "sketch", "cell", "_order"])

    schema = T.StructType([*(rows.schema[n] for n in KEYS), T.StructField("sketch", T.BinaryType()), T.StructField("cell", T.IntegerType()), T.StructField("_order", T.DoubleType())])
    path = scratch_path(spark, "index")
    rows.mapInArrow(sketched, schema).hint("rebalance", "cell").sortWithinPartitions("cell", "_order").drop("_order").write.partitionBy("cell").parquet(path)
    table = spark.read.schema(T.StructType([f for f in schema.fields if f.name != "_order"])).parquet(path)

    def boxed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, cells = _unpacked(b.column(1)), b.column(0).to_numpy(zero_copy_only=False)
            for c in np.unique(cells):
                mine = s[cells == c]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(s.shape[1], c), pa.int32()), pa.array(np.arange(s.shape[1]), pa.int32()), pa.array(mine.min(axis=0)), pa.array(mine.max(axis=0))], names=["cell", "k", "low", "high"])

    sides = table.select("cell", "sketch").mapInArrow(boxed, "cell int, k int, low double, high double").groupBy("cell", "k").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("cell", "k").toPandas()
    width = along.shape[1] + 1
    return WindowIndex(table, rows, along, sides["cell"].tolist()[::width], *(sides[n].to_numpy().reshape(-1, width) for n in ("low", "high")))


def beyond(low: np.ndarray, high: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least distance of each point (rows of at) to each box (rows of low and high): boxes x points."""
    gap = np.maximum(np.maximum(low[:, None, :] - at[None], at[None] - high[:, None, :]), 0.0)
    return np.sqrt((gap * gap).sum(axis=2))


def _reach(similarity: np.ndarray) -> np.ndarray:
    """The greatest distance whose similarity may still round to as much; a little more, for float noise."""
    return np.where(similarity > 1e-8, (1.0 / np.maximum(similarity - 1e-8, 1e-12) - 1.0) * (1 + 1e-9) + 1e-9, np.inf)


def _search(index: WindowIndex, cells: set[int], targets: list, reach: np.ndarray, top: int) -> DataFrame:
    """NEAR: the windows that may be among the best of each target, with bounds of their distance from below and above, by sketches alone.

    What lies outside the directions differs by the difference of its lengths at least and by their sum at most; a task's k-th least
    upper bound ends what it goes on with.
    """
    rows = index.table.where(F.col("cell").isin(sorted(cells))) if len(cells) < len(index.cells) else index.table
    sketches = sketch(np.array([r.target_vec for r in targets], float), index.along)
    codes, ends = [r.target_code for r in targets], [r.target_end for r in targets]
    kind = index.table.schema["code"].dataType
    types = [pa.int32(), to_arrow_type(kind), pa.date32(), pa.date32(), pa.float64(), pa.float64()]
    names = ["target", *KEYS, "low", "high"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = reach.copy()
        least = [np.zeros(0) for _ in targets]
        for batch in batches:
            parts, found = _unpacked(batch.column(3)), []
            for at in range(0, len(parts), BLOCK):
                part = parts[at : at + BLOCK]
                for t in np.flatnonzero(beyond(part.min(axis=0, keepdims=True), part.max(axis=0, keepdims=True), sketches)[0] <= bound):
                    gap = part - sketches[t]
                    squares = gap * gap
                    low = np.sqrt(squares.sum(axis=1))
                    some = np.flatnonzero(low <= bound[t])
                    keys = zip(*(batch.column(k).take(pa.array(at + some)).to_pylist() for k in (0, 2)), strict=True)
                    some = some[[k != (codes[t], ends[t]) for k in keys]] if len(some) else some
                    if not len(some):
                        continue
                    high = np.sqrt(squares[some, :-1].sum(axis=1) + (part[some, -1] + sketches[t, -1]) ** 2)
                    found.append((t, at + some, low[some], high))
                    least[t] = np.sort(np.concatenate([least[t], high]))[:top]
                    if len(least[t]) >= top:
                        bound[t] = min(bound[t], float(_reach(np.array([_like(least[t][-1])]))[0]))
            for t, some, low, high in found:
                still = low <= bound[t]
                taken = pa.array(some[still])
                columns = [pa.array(np.full(len(taken), t), pa.int32()), *(batch.column(k).take(taken) for k in range(3)), pa.array(low[still]), pa.array(high[still])]
                yield pa.RecordBatch.from_arrays([x.cast(y) for x, y in zip(columns, types, strict=True)], names=names)

    return rows.select(*KEYS, "sketch").mapInArrow(run, NEAR.format(code=kind.simpleString()))


def _like(distance: float) -> float:
    return round(1.0 / (1.0 + float(distance)), 9)


def _first(rows: DataFrame, by: Column, many: int) -> DataFrame:
    """The first rows of each target, with their place."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy("target").orderBy(by))).where(F.col("place") <= many)


def _fetched(index: WindowIndex, near: DataFrame, block: list, reach: np.ndarray, code: str) -> list[DataFrame]:
    """The windows of near that are within reach, with their similarity: vectors are looked up where they lie, by keys.

    Keys are broadcast, FETCHED at a time; of one target alone they may be more, and then Spark chooses how to join.
    """
    spark = near.sparkSession
    wanted = spark.createDataFrame([(t, r.target_code, r.target_end, [float(x) for x in r.target_vec], float(reach[t])) for t, r in enumerate(block)], f"target int, target_code {code}, target_end date, target_vec array<double>, reach double")
    near = near.join(F.broadcast(wanted.select("target", "reach")), "target").where("low <= reach").select("target", *[F.col(k).alias(f"_{k}") for k in KEYS]).distinct()
    near = written(near, "candidates")
    parts: list[tuple[int, list[int]]] = []
    for r in near.groupBy("target").count().orderBy("target").collect():  # a row a target
        if parts and parts[-1][0] + r["count"] <= FETCHED:
            parts[-1] = (parts[-1][0] + r["count"], [*parts[-1][1], r.target])
        else:
            parts.append((r["count"], [r.target]))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in KEYS])
    whole = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("vec") == F.size("target_vec"))
    squares = F.aggregate(F.zip_with("vec", "target_vec", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    out = []
    for count, some in parts:
        keys = near.where(F.col("target").isin(some))
        rows = index.source.join(F.broadcast(keys) if count <= FETCHED else keys, same).join(F.broadcast(wanted), "target").where(whole)
        out.append(written(rows.select("target", "target_code", "target_end", *KEYS, F.round(1.0 / (1.0 + F.sqrt(squares)), 9).alias("similarity"), "future_days"), "similar"))
    return out


def search(index: WindowIndex, targets: DataFrame, top: int = 10, least: float | None = None) -> tuple[DataFrame, dict[str, int]]:
    """The windows most like each target by distance, best first, and how many distances were computed of how many pairs.

    Exact: a cell, a block or a window is passed over only if its bound says that it cannot be among the best.  First each target looks at
    its nearest cell: a few windows with the least bounds are measured there, and their k-th best bounds the rest; what all cells then have
    within that bound is fetched and measured.  targets: target_code, target_end, target_vec, a stated set of queries, taken in blocks of TARGETS.
    """
    spark = index.table.sparkSession
    found, counts, total = [], {"distances": 0, "pairs": 0}, index.table.count()
    kind = targets.schema["target_code"].dataType.simpleString()
    many = targets.orderBy("target_code", "target_end").toLocalIterator()
    while block := list(itertools.islice(many, TARGETS)):
        block = [r for r in block if r.target_vec is not None and np.isfinite(np.array(r.target_vec, float)).all()]
        if not block or not index.cells:
            continue
        counts["pairs"] += len(block) * total
        reach = np.full(len(block), np.inf if least is None else float(_reach(np.array([least]))[0]))
        far = beyond(index.low, index.high, sketch(np.array([r.target_vec for r in block], float), index.along))
        nearest = _search(index, {index.cells[k] for k in far.argmin(axis=0)}, block, reach, top)
        for part in _fetched(index, _first(nearest, F.col("low"), FIRST * top).drop("place"), block, reach, kind):
            counts["distances"] += part.count()
            for r in _first(part, F.col("similarity").desc(), top).where(F.col("place") == top).select("target", "similarity").collect():  # a row a target
                reach[r.target] = min(reach[r.target], float(_reach(np.array([r.similarity]))[0]))
        near = _search(index, {index.cells[k] for k in np.flatnonzero((far <= reach[None]).any(axis=1))}, block, reach, top)
        for part in _fetched(index, near, block, reach, kind):
            counts["distances"] += part.count()
            found.append(part.drop("target"))
    out = _ranked(reduce(DataFrame.unionByName, found), top, least) if found else None
    empty = "target_code {0}, target_end date, code {1}, start_date date, end_date date, similarity double, place int, future_days long"
    return (out if out is not None else spark.createDataFrame([], empty.format(kind, index.table.schema["code"].dataType.simpleString()))), counts


def _ranked(pairs: DataFrame, top: int, least: float | None) -> DataFrame:
    if least is not None:
        pairs = pairs.where(F.col("similarity") >= least)
    line = W.partitionBy("target_code", "target_end").orderBy(F.col("similarity").desc(), "code", "start_date")
    pairs = pairs.withColumn("place", F.row_number().over(line)).where(F.col("place") <= top)
    return pairs.select("target_code", "target_end", "code", "start_date", "end_date", "similarity", "place", "future_days")


def similar_windows(vectors: DataFrame, targets: DataFrame, top: int = 10, metric: str = "euclid", least: float | None = None) -> DataFrame:
    """The windows most like each target, best first. targets: target_code, target_end, target_vec, a stated set of queries.

    By distance through an index (search()); by product or cosine every window meets every target, in blocks of TARGETS that are
    broadcast, and the best ``top`` of a target are kept before anything is shuffled.
    """
    if metric == "euclid":
        return search(build_index(vectors), targets, top, least)[0]
    spark, schema = vectors.sparkSession, targets.schema
    found, block = None, []
    rows = targets.orderBy("target_code", "target_end").toLocalIterator()
    while block := list(itertools.islice(rows, TARGETS)):
        part = _similar(vectors, spark.createDataFrame(block, schema), top, metric, least)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else _similar(vectors, targets, top, metric, least)


def _similar(vectors: DataFrame, targets: DataFrame, top: int, metric: str, least: float | None) -> DataFrame:
    pairs = vectors.join(F.broadcast(targets), ~((F.col("code") == F.col("target_code")) & (F.col("end_date") == F.col("target_end"))))
    total = lambda values: F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    like = total(F.zip_with("vec", "target_vec", lambda a, b: a * b)) / F.sqrt(total(F.transform("vec", lambda a: a * a)))
    if metric == "cosine":
        like = like / F.sqrt(total(F.transform("target_vec", lambda a: a * a)))
    return _ranked(pairs.withColumn("similarity", F.round(like, 9)), top, least)


# ---- windows that are written nowhere: a row a code, searched as it is read ----------------------------------------------

#: The columns of a window's vector, in order.
CELLS_OF = (*PRICES, "turnover", "pct_chg")
#: Rows of a file of codes, windows of a code that go to Python as a row, windows and targets that meet at a time, pairs measured at a time.
CODES, PIECE, MEET, ASKED, MEASURED = 512, 64, 2048, 2_000, 100_000
_NO_DAY = -(1 << 31)


def pack_bars(bars: DataFrame) -> DataFrame:
    """A row a code: arrays of its dates and of its repaired cells, in order of date; each bar lies there once, not in every window."""
    rows = F.sort_array(F.collect_list(F.struct("date", *CELLS_OF)))
    return repaired(bars).select("code", "date", *CELLS_OF).groupBy("code").agg(rows.alias("_rows")).select("code", *[F.col(f"_rows.{x}").alias(x) for x in ("date", *CELLS_OF)])


def _pieces(packed: DataFrame, length: int) -> DataFrame:
    """The bars of PIECE windows that follow each other, and how many bars of the code come behind them."""
    many = PIECE + length - 1
    at = packed.where(F.size("date") >= length).withColumn("_at", F.explode(F.sequence(F.lit(1), F.size("date") - (length - 1), F.lit(PIECE))))
    behind = F.greatest(F.size("date") - F.col("_at") - (many - 1), F.lit(0))
    return at.select("code", behind.alias("_behind"), *[F.slice(x, F.col("_at"), many).alias(x) for x in ("date", *CELLS_OF)])


def _made(batch: pa.RecordBatch, length: int, horizon: int, by: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of ``by`` windows at a time of _pieces(): vectors, rows of the batch, first and last days as numbers, future days."""
    sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
    days = pc.fill_null(batch.column(2).flatten().cast(pa.int32()), _NO_DAY).to_numpy(zero_copy_only=False)
    cells = np.stack([batch.column(k).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for k in range(3, 3 + len(CELLS_OF))])
    counts, behind = sizes - (length - 1), batch.column(1).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.repeat(np.cumsum(sizes) - sizes, counts) + place
    left = np.minimum(np.repeat(sizes, counts) - place - length + behind[row], horizon)
    close = PRICES.index("close")
    for k in range(0, len(row), by):
        some = slice(k, k + by)
        made = cells[:, start[some, None] + np.arange(length)]
        first = np.where(made[close, :, 0] == 0, 1.0, made[close, :, 0])
        made[: len(PRICES)] /= first[None, :, None]
        yield made.transpose(1, 0, 2).reshape(len(first), -1), row[some], days[start[some]], days[start[some] + length - 1], left[some]


def _days(numbers: list[int]) -> pa.Array:
    return pa.array([None if x == _NO_DAY else x for x in numbers], pa.int32()).cast(pa.date32())


def packed_vectors(packed: DataFrame, length: int = 7, horizon: int = 5) -> DataFrame:
    """window_vectors() of packed bars."""
    kind = packed.schema["code"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, row, start, end, left in _made(batch, length, horizon, MEET):
                vec = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), _days(start.tolist()), _days(end.tolist()), vec, pa.array(left, pa.int64())], names=["code", "start_date", "end_date", "vec", "future_days"])

    return _pieces(packed, length).mapInArrow(run, f"code {kind.simpleString()}, start_date date, end_date date, vec array<double>, future_days long")


def _rounded(distance: float) -> float:
    """The similarity to 9 places, halves up as in SQL."""
    return float(Decimal(repr(1.0 / (1.0 + distance))).quantize(Decimal("1e-9"), ROUND_HALF_UP))


def search_packed(packed: DataFrame, targets: DataFrame, top: int = 10, least: float | None = None, length: int = 7, horizon: int = 5) -> DataFrame:
    """What search() finds among the windows of packed bars, without an index: nothing of the size of the windows is written or dealt.

    A task makes the windows of its codes as it reads them; products of matrices give all distances but for float noise, and what is
    not beyond the k-th best by more than that noise is measured.  A task hands on its ``top`` best rows of each target.  Exact.
    Every target meets every window, so time is their product; targets are taken ASKED at a time, each time in one pass.
    """
    spark, kind = packed.sparkSession, packed.schema["code"].dataType
    code = kind.simpleString()
    many, found = targets.orderBy("target_code", "target_end").toLocalIterator(), []
    while block := list(itertools.islice(many, ASKED)):
        block = [r for r in block if r.target_vec is not None and len(r.target_vec) == length * len(CELLS_OF) and np.isfinite(np.array(r.target_vec, float)).all()]
        if block:
            wanted = spark.createDataFrame([(t, r.target_code, r.target_end) for t, r in enumerate(block)], f"target int, target_code {targets.schema['target_code'].dataType.simpleString()}, target_end date")
            rows = _pieces(packed, length).mapInArrow(_best_of(block, top, least, length, horizon, kind), f"target int, code {code}, start_date date, end_date date, similarity double, future_days long")
            found.append(written(_ranked(rows.join(F.broadcast(wanted), "target"), top, least), "similar"))
    empty = f"target_code {targets.schema['target_code'].dataType.simpleString()}, target_end date, code {code}, start_date date, end_date date, similarity double, place int, future_days long"
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], empty)


def _best_of(block: list, top: int, least: float | None, length: int, horizon: int, kind: T.DataType):
    """The task of search_packed(): batches of _pieces() to the best windows of each target."""
    asked = np.array([r.target_vec for r in block], float)
    epoch = np.datetime64("1970-01-01", "D")
    own = [(r.target_code, _NO_DAY if r.target_end is None else int((np.datetime64(r.target_end, "D") - epoch).astype(int))) for r in block]
    reach = np.inf if least is None else float(_reach(np.array([least]))[0])
    order = lambda x: (-x[0], x[1] is not None, x[1], x[2], x[3])

    def measured(v: np.ndarray, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distances, summed in the order of the cells."""
        out = np.empty(len(rows))
        for k in range(0, len(rows), MEASURED):
            gap = v[rows[k : k + MEASURED]] - asked[at[k : k + MEASURED]]
            total = np.zeros(len(gap))
            for x in gap.T:
                total += x * x
            out[k : k + MEASURED] = np.sqrt(total)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in block]
        bound = np.full(len(block), reach)
        keep = 1.0 - 1e-13  # squares a little short, so that noise makes a distance smaller, never greater
        with np.errstate(all="ignore"):
            sides = np.vstack([-2.0 * asked.T, np.ones(len(block)), keep * (asked * asked).sum(axis=1)])
            for batch in batches:
                codes = batch.column(0)
                for v, row, start, end, left in _made(batch, length, horizon, MEET):
                    whole = np.isfinite(v).all(axis=1)
                    if not whole.all():
                        v, row, start, end, left = (x[whole] for x in (v, row, start, end, left))
                    if not len(v):
                        continue
                    square = np.column_stack([v, keep * (v * v).sum(axis=1), np.ones(len(v))]) @ sides
                    free = np.flatnonzero(np.isinf(bound))
                    if len(free) and len(v) > top + 1:  # a bound of the first windows: the window itself may be among them
                        near = np.argpartition(square[:, free], top, axis=0)[: top + 1]
                        far = measured(v, near.ravel(), np.tile(free, top + 1)).reshape(near.shape).max(axis=0)
                        bound[free] = np.nan_to_num(_reach(1.0 / (1.0 + far)), nan=np.inf)
                    rows, at = np.divmod(np.flatnonzero(~(square > bound * bound)), len(block))
                    for k in range(0, len(rows), MEASURED):
                        some, which = rows[k : k + MEASURED], at[k : k + MEASURED]
                        far = measured(v, some, which)
                        names = codes.take(pa.array(row[some])).to_pylist()
                        fresh: dict[int, list[tuple]] = {}
                        for t, d, c, s, e, f in zip(which.tolist(), far.tolist(), names, start[some].tolist(), end[some].tolist(), left[some].tolist(), strict=True):
                            if d <= bound[t] and (c, e) != own[t]:
                                fresh.setdefault(t, []).append((_rounded(d), c, s, e, f))
                        for t, more in fresh.items():
                            best[t] = sorted(best[t] + more, key=order)[:top]
                            if len(best[t]) == top:
                                bound[t] = min(bound[t], float(_reach(np.array([best[t][-1][0]]))[0]))
        flat = [(t, *x) for t, rows in enumerate(best) for x in rows]
        for k in range(0, len(flat), 10_000):
            t, like, c, s, e, f = (list(x) for x in zip(*flat[k : k + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(t, pa.int32()), pa.array(c, to_arrow_type(kind)), _days(s), _days(e), pa.array(like, pa.float64()), pa.array(f, pa.int64())],
                names=["target", "code", "start_date", "end_date", "similarity", "future_days"])

    return run


def window_rows(bars: DataFrame, windows: DataFrame, length: int = 7, horizon: int = 5) -> DataFrame:
    """What a chart of windows (code, end_date) shows: their rows and up to ``horizon`` rows after them.

    code, end_date, offset (0 at the window's last row, above it the future), date, the prices over the window's first close (0 counts as 1),
    future_days.  Windows are equal rows once; one whose end is no row of its code, or that lacks rows before, has none.  Rows are
    found by their place in the code, an equi join.
    """
    numbered = bars.select("code", "date", *PRICES, F.row_number().over(w()).alias("_k"))
    ends = windows.select("code", "end_date").distinct().join(numbered.select("code", F.col("date").alias("end_date"), F.col("_k").alias("_end")), ["code", "end_date"]).where(F.col("_end") >= length)
    spread = ends.withColumn("offset", F.explode(F.sequence(F.lit(1 - length), F.lit(horizon)))).withColumn("_k", F.col("_end") + F.col("offset"))
    rows = spread.join(numbered, ["code", "_k"])
    mine = W.partitionBy("code", "end_date")
    first = F.max(F.when(F.col("offset") == 1 - length, F.col("close"))).over(mine)
    base = F.when(first == 0, 1.0).otherwise(first)
    shown = {f"rel_{p}": F.col(p) / base for p in PRICES} | {"future_days": F.sum((F.col("offset") > 0).cast("int")).over(mine)}
    return rows.withColumns(shown).select("code", "end_date", "offset", "date", *[f"rel_{p}" for p in PRICES], "future_days")


def packed_rows(packed: DataFrame, windows: DataFrame, length: int = 7, horizon: int = 5) -> DataFrame:
    """window_rows() of packed bars: the bars of a window are cut out of its code's row, so no bar travels."""
    rows = packed.join(windows.select("code", "end_date").distinct(), "code").withColumn("_end", F.array_position("date", F.col("end_date"))).where(F.col("_end") >= length)
    rows = rows.select("code", "end_date", *[F.slice(x, F.col("_end").cast("int") - (length - 1), length + horizon).alias(f"_{x}") for x in ("date", *PRICES)])
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0), F.size("_date") - 1)))
    first = F.col("_close")[0]
    base = F.when(first == 0, 1.0).otherwise(first)
    shown = [(F.col(f"_{p}")[F.col("_j")] / base).alias(f"rel_{p}") for p in PRICES]
    return rows.select("code", "end_date", (F.col("_j") - (length - 1)).alias("offset"), F.col("_date")[F.col("_j")].alias("date"), *shown, (F.size("_date") - length).cast("long").alias("future_days"))

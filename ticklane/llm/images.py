"""Copies of images, cropped, turned, scaled or edited: multiscale corners, orientation-normalised binary tests, Hamming tables,
geometric consensus.

An image is a binary PGM (P5).  Corners are local maxima of the Harris response on a pyramid whose levels differ by the cube root
of two, placed between pixels; each has the direction of its patch's intensity centroid and ``BITS`` comparisons of pairs of
blurred places turned to that direction.  A level's corners grow with its mean side (``PIXELS``, ``CORNERS``).  Equal images are
one image from there on.  Each of ``TABLES`` parts of a descriptor is filed in a Hamming table; two corners that share an
entry are a possible match, and images with ``INLIERS`` possible matches or more are compared: matches that hold on the whole
descriptor vote for a scale, a turn and a shift, and ``INLIERS`` votes that agree make a link.  Classes are components.

First every image is only compared with the least image of each entry, which finds large groups of copies in linear work;
then images that share entries and are still in different classes are compared, so the classes are those of all pairs.  In an
entry, the images of its largest class meet those of the others, which meet one another; nothing is paired within a class.
Entries of many images are dealt to blocks of about ``BLOCK``, and pairs of blocks meet in their own tasks.  Of entries with
more than ``BLOCK`` images each image leaves out its ``SPARED`` most frequent ones, and pairs need so many matches less to be
compared: of INLIERS entries that two images share, one at least is left out by neither.

Defined cases: a null, empty or malformed image, and one too small or too flat for corners, has no features and is a class of
its own with its exact copies (nulls are no copies of one another); null ids are never a class's name; repeated rows share a
class; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ticklane.llm.components import components
from ticklane.llm.shared import Scratch, join_totals, map_batches

BITS, TABLES, CHUNK = 288, 6, 48
#: Pixels around a corner that its descriptor sees, and how near to the border corners are looked for.
RADIUS, MARGIN = 10, 4
#: Ratio of neighbouring levels of the pyramid; blur (deviation in pixels) before corners and before the tests.
STEP, BLUR, SOFT = 2 ** (1 / 3), 1.5, 1.5
#: Pixels that the shorter side of the smallest level has at least.
LEAST = 14
#: Corners of a level, strongest first: one for so many pixels of its mean side, and so many at least.
PIXELS, CORNERS = 3, 16
#: Bits of a match's descriptors that may differ; matches that must agree; how far off (pixels, and share of the distance).
REACH, INLIERS, SLACK, BEND = 50, 3, 3.0, 0.07
#: A proposal with so many votes needs no better one.
ENOUGH = 8
#: Images of a table entry that meet in one task.
BLOCK = 512


def _pattern(seed: int = 7) -> np.ndarray:
    """Points of the tests around an upright corner: (bits, 2, 2) offsets (y, x), even over the disc.

    Two points lie rather beside each other than along the corner's direction, in which a patch grows brighter by itself: such
    tests would say the same of most corners.
    """
    rng = np.random.default_rng(seed)
    far, way = 0.95 * RADIUS * np.sqrt(rng.random((8 * BITS, 2))), 2 * np.pi * rng.random((8 * BITS, 2))
    points = np.stack([far * np.sin(way), far * np.cos(way)], axis=2)
    across = np.abs(points[:, 1] - points[:, 0])
    return points[across[:, 1] <= across[:, 0]][:BITS]


_PATTERN = _pattern()
_DY, _DX = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
_DISC = (_DY**2 + _DX**2) <= RADIUS**2
_DY, _DX = _DY[_DISC], _DX[_DISC]


def encode_pgm(pixels: np.ndarray) -> bytes:
    return f"P5\n{pixels.shape[1]} {pixels.shape[0]}\n255\n".encode() + np.clip(pixels, 0, 255).astype(np.uint8).tobytes()


def decode_pgm(data: bytes | None) -> np.ndarray | None:
    """Pixels of a binary PGM of 8 bits, None if it is none."""
    head = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not head or int(head[3]) > 255:
        return None
    width, height = int(head[1]), int(head[2])
    body = data[head.end() :]
    return np.frombuffer(body, np.uint8, width * height).reshape(height, width).astype(np.float32) if len(body) >= width * height > 0 else None


@functools.lru_cache(maxsize=256)
def _line(size: int, scale: float, deviation: float) -> np.ndarray:
    """Matrix (new size, size) that blurs a line of pixels and takes one for every ``scale``; edges are repeated."""
    new = round(size / scale)
    at = (np.arange(new) + 0.5) * scale - 0.5
    far = np.arange(-int(4 * deviation) - 1, size + int(4 * deviation) + 1)
    weight = np.exp(-((far[None, :] - at[:, None]) ** 2) / (2 * deviation**2))
    out = np.zeros((new, size))
    np.add.at(out.T, np.clip(far, 0, size - 1), weight.T)
    return out / out.sum(axis=1, keepdims=True)


def _blurred(x: np.ndarray, deviation: float, scale: float = 1.0) -> np.ndarray:
    """x blurred and, with a scale above 1, made smaller."""
    if max(x.shape) <= 256:
        return _line(x.shape[0], scale, deviation) @ x @ _line(x.shape[1], scale, deviation).T
    for axis in (0, 1):  # a large picture: only the pixels near a place are weighed
        size = x.shape[axis]
        at = (np.arange(round(size / scale)) + 0.5) * scale - 0.5
        reach, near = int(4 * deviation) + 1, np.rint(at).astype(int)
        shape = [-1 if k == axis else 1 for k in (0, 1)]
        total, out = np.zeros(len(at)), 0.0
        for k in range(-reach, reach + 1):
            weight = np.exp(-((near + k - at) ** 2) / (2 * deviation**2))
            out = out + np.take(x, np.clip(near + k, 0, size - 1), axis=axis) * weight.reshape(shape)
            total += weight
        x = out / total.reshape(shape)
    return x


def _at(x: np.ndarray, ys: np.ndarray, xs: np.ndarray) -> np.ndarray:
    """Values of x between its pixels; outside, those of the border."""
    ys, xs = np.clip(ys, 0, x.shape[0] - 1.001), np.clip(xs, 0, x.shape[1] - 1.001)
    y, z = ys.astype(np.int32), xs.astype(np.int32)
    down, right = ys - y, xs - z
    flat, first = x.ravel(), y * x.shape[1] + z
    upper = flat[first] * (1 - right) + flat[first + 1] * right
    first += x.shape[1]
    return upper * (1 - down) + (flat[first] * (1 - right) + flat[first + 1] * right) * down


def _peak(before: np.ndarray, here: np.ndarray, after: np.ndarray) -> np.ndarray:
    """How far from the middle one the top of the parabola through three values is."""
    bend = before - 2 * here + after
    return np.where(bend < 0, np.clip(0.5 * (before - after) / np.where(bend < 0, bend, 1), -0.5, 0.5), 0.0)


def features(pixels: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors (n, BITS / 8 bytes) and geometry (n, 4: y, x in pixels of the image, scale, turn) of an image."""
    none = np.zeros((0, BITS // 8), np.uint8), np.zeros((0, 4), np.float32)
    if pixels is None:
        return none
    found_d, found_g = [], []
    whole = pixels.astype(np.float64)
    for level in range(64):
        scale = STEP**level
        if round(min(whole.shape) / scale) < LEAST:
            break
        level_pixels = _blurred(whole, 0.5 * np.sqrt(scale**2 - 1), scale) if level else whole
        calm = _blurred(level_pixels, BLUR)
        gy, gx = np.gradient(calm)
        a, c, d = (_blurred(x, 1.4) for x in (gx * gx, gy * gy, gx * gy))
        response = a * c - d * d - 0.04 * (a + c) ** 2
        top = response
        for axis in (0, 1):
            wide = np.pad(top, [(2, 2) if k == axis else (0, 0) for k in (0, 1)], constant_values=-np.inf)
            top = functools.reduce(np.maximum, [wide[k : k + top.shape[0]] if axis == 0 else wide[:, k : k + top.shape[1]] for k in range(5)])
        peaks = (response == top) & (response > 1e-3 * max(1.0, float(response.max())))
        ys, xs = np.nonzero(peaks[MARGIN:-MARGIN, MARGIN:-MARGIN])
        ys, xs = ys + MARGIN, xs + MARGIN
        order = np.lexsort((xs, ys, -response[ys, xs]))[: max(CORNERS, int(response.size**0.5 / PIXELS))]
        ys, xs = ys[order], xs[order]
        if len(ys):
            y = ys + _peak(response[ys - 1, xs], response[ys, xs], response[ys + 1, xs])
            x = xs + _peak(response[ys, xs - 1], response[ys, xs], response[ys, xs + 1])
            soft = _blurred(level_pixels, SOFT)
            patch = _at(soft, y[:, None] + _DY, x[:, None] + _DX)
            turn = np.arctan2(patch @ _DY, patch @ _DX)
            cos, sin = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
            there = _at(soft, y[:, None, None] + cos * _PATTERN[:, :, 0] + sin * _PATTERN[:, :, 1], x[:, None, None] + cos * _PATTERN[:, :, 1] - sin * _PATTERN[:, :, 0])
            there = np.rint(there * 32)  # on a grid, so that even areas say the same whatever the last bits are
            found_d.append(np.packbits(there[:, :, 0] < there[:, :, 1], axis=1))
            found_g.append(np.stack([(y + 0.5) * scale - 0.5, (x + 0.5) * scale - 0.5, np.full(len(y), scale), turn], axis=1).astype(np.float32))
    return (np.concatenate(found_d), np.concatenate(found_g)) if found_d else none


def parts(descriptors: np.ndarray) -> np.ndarray:
    """The part of each descriptor that each table files, (n, TABLES): long enough that unrelated corners seldom share one."""
    width = CHUNK // 8
    cells = descriptors[:, : TABLES * width].reshape(len(descriptors), TABLES, width).astype(np.int64)
    return (cells << (8 * np.arange(width - 1, -1, -1))).sum(axis=2)


def consensus(da: np.ndarray, ga: np.ndarray, db: np.ndarray, gb: np.ndarray, pairs: np.ndarray) -> int:
    """Most matches, among pairs (i, j), that agree on one scale, turn and shift; each corner counts once."""
    near = np.bitwise_count(da[pairs[:, 0]] ^ db[pairs[:, 1]]).sum(axis=1) <= REACH
    pairs = pairs[near]
    if len(pairs) < INLIERS:
        return 0
    a, b = ga[pairs[:, 0]].astype(np.float64), gb[pairs[:, 1]].astype(np.float64)
    scale, turn = b[:, 2] / a[:, 2], b[:, 3] - a[:, 3]
    best = 0
    for k in range(len(pairs)):  # each match proposes; a proposal is checked against all at once
        if best >= ENOUGH:
            break
        cos, sin = np.cos(turn[k]) * scale[k], np.sin(turn[k]) * scale[k]
        dy, dx = a[:, 0] - a[k, 0], a[:, 1] - a[k, 1]
        off = np.hypot(b[:, 0] - b[k, 0] - (sin * dx + cos * dy), b[:, 1] - b[k, 1] - (cos * dx - sin * dy))
        swing = np.abs(np.angle(np.exp(1j * (turn - turn[k]))))
        ok = (off <= SLACK * max(1.0, scale[k]) + BEND * scale[k] * np.hypot(dy, dx)) & (swing <= 0.35) & (np.abs(np.log2(scale / scale[k])) < 0.5)
        best = max(best, min(len(np.unique(pairs[ok, 0])), len(np.unique(pairs[ok, 1]))))
    return best


#: Most frequent entries that an image leaves out where they are long; INLIERS - SPARED matches are then enough to be compared.
SPARED = 2


def feature_table(images: DataFrame, scratch: Scratch, read=None) -> DataFrame:
    """id, img (a number for the row), same (equal for equal images), descriptors and geometry of (id, image). Images are not moved.

    read: makes the bytes of an image of a value of the column, in the task that describes it; without it they are the value.
    """

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, descriptors, geometry = [], [], []
            for value in batch.column(1):
                data = read(value.as_py()) if read else value.as_py()
                d, g = features(decode_pgm(data))
                digests.append(hashlib.sha256(data).hexdigest() if data else None)
                descriptors.append(d.tobytes())
                geometry.append(g.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string()), pa.array(descriptors, pa.binary()), pa.array(geometry, pa.binary())], names=["id", "digest", "descriptors", "geometry"])

    made = map_batches(images.select("id", "image"), described, "id long, digest string, descriptors binary, geometry binary")
    return scratch.cut(made.withColumn("img", F.monotonically_increasing_id())).withColumn("same", F.coalesce("digest", F.concat(F.lit("none-"), F.col("img").cast("string")))).drop("digest")


def entries_of(table: DataFrame) -> DataFrame:
    """entry, img, i: a row for each corner and Hamming table."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, images, corners = [], [], []
            for img, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = parts(np.frombuffer(data, np.uint8).reshape(-1, BITS // 8)) + (np.arange(TABLES, dtype=np.int64) << CHUNK)
                keys.append(own.ravel())
                images.append(np.full(own.size, img, np.int64))
                corners.append(np.repeat(np.arange(len(own), dtype=np.int32), TABLES))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, images, corners)], names=["entry", "img", "i"])

    return map_batches(table.select("img", "descriptors"), filed, "entry long, img long, i int")


def possible(da: np.ndarray, db: np.ndarray) -> np.ndarray:
    """Pairs (i, j) of corners that share an entry."""
    one, two = parts(da), parts(db)
    found = [np.argwhere(one[:, None, k] == two[None, :, k]) for k in range(TABLES)]
    return np.unique(np.concatenate(found), axis=0)


def _linked(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """a, b of the image pairs (a, b) whose matches agree. Few pairs reach the joins with features."""
    one = lambda side: table.select(F.col("img").alias(side), F.col("descriptors").alias(f"d{side}"), F.col("geometry").alias(f"g{side}"))
    whole = pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "da", "ga", "db", "gb")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for row in batch.to_pylist():
                d = [np.frombuffer(row[k], np.uint8).reshape(-1, BITS // 8) for k in ("da", "db")]
                g = [np.frombuffer(row[k], np.float32).reshape(-1, 4) for k in ("ga", "gb")]
                keep.append(consensus(d[0], g[0], d[1], g[1], possible(*d)) >= INLIERS)
            yield pa.RecordBatch.from_arrays([x.filter(pa.array(keep, pa.bool_())) for x in batch.columns[:2]], names=["a", "b"])

    return map_batches(whole, checked, "a long, b long")


def _between(named: DataFrame, block: int, scratch: Scratch) -> DataFrame:
    """a, b: images of different classes with enough possible matches, from the entries (entry, img, i, root) they are in."""
    classes_ = named.groupBy("entry", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = classes_.groupBy("entry").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main"))
    rows = scratch.cut(named.join(mixed.where("classes > 1").drop("classes"), "entry"))  # an image has hundreds of entries, so none is hot
    # images leave out their most frequent long entries, in one order for all images
    line = W.partitionBy("img").orderBy(F.col("n").desc(), "entry", "i")
    long_ = rows.where(F.col("n") > block).withColumn("_k", F.row_number().over(line)).where(F.col("_k") <= SPARED)
    out = scratch.cut(long_.select("entry", "img", "i"))
    spared = out.groupBy("img").agg(F.count(F.lit(1)).alias("spared"))
    rows = rows.join(out, ["entry", "img", "i"], "left_anti").join(spared, "img", "left").fillna({"spared": 0})
    # the images outside the main class, in blocks, meet blocks of all; where they are few, the many are not repeated
    rows = scratch.cut(rows.withColumns({"lefts": F.ceil((F.col("n") - F.col("most")) / block), "rights": F.ceil(F.col("n") / block)}))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    own = lambda parts: F.pmod(F.xxhash64("img"), F.col(parts))
    left = rows.where("root <> main").select("entry", own("lefts").alias("part"), each("rights").alias("other"), "root", F.col("img").alias("a"), "i", F.col("spared").alias("s"))
    right = rows.select("entry", each("lefts").alias("part"), own("rights").alias("other"), F.col("root").alias("root2"), "main", F.col("img").alias("b"), F.col("i").alias("j"), F.col("spared").alias("s2"))
    met = left.join(right, ["entry", "part", "other"]).where((F.col("root2") == F.col("main")) | (F.col("root") < F.col("root2")))
    ends = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.when(F.col("a") < F.col("b"), F.array("i", "j")).otherwise(F.array("j", "i")).alias("m"), F.greatest("s", "s2").alias("s")]
    pairs = met.select(*ends).groupBy("x", "y").agg(F.collect_set("m").alias("m"), F.max("s").alias("s"))
    return pairs.where(F.size("m") >= INLIERS - F.col("s")).select(F.col("x").alias("a"), F.col("y").alias("b"))


def classes(images: DataFrame, key: str = "image_id", column: str = "image", block: int = BLOCK, read=None) -> DataFrame:
    """key, class_id of every row: the least key of the images that are copies of one another, cropped, turned, scaled or edited.

    read: see feature_table().
    """
    scratch = Scratch(images.sparkSession, "images")
    every = feature_table(images.select(F.col(key).cast("long").alias("id"), F.col(column).alias("image")), scratch, read)
    each = every.select("id", "img", "same")
    groups = scratch.cut(each.groupBy("same").agg(F.min("id").alias("least"), F.min("img").alias("rep"), F.count(F.lit(1)).alias("n")))
    each = scratch.cut(join_totals(each, groups, ["same"], "n", each.count()).select("id", "img", "rep"))
    more = scratch.cut(each.where("img <> rep").select("img"))
    table = every.select("img", "descriptors", "geometry")
    entries = entries_of(table.join(more, "img", "left_anti"))
    # entries with one image say nothing; which have more is known from two numbers an entry
    shared = entries.groupBy("entry").agg(F.min("img").alias("head"), F.max("img").alias("last"), F.count(F.lit(1)).alias("n")).where("head <> last").drop("last")
    entries = scratch.cut(entries.join(shared, "entry"))
    heads = entries.where("img = head").select("entry", F.col("head").alias("a"), "i")
    matches = heads.join(entries.where("img <> head").select("entry", F.col("img").alias("b"), F.col("i").alias("j")), "entry")
    near = matches.groupBy("a", "b").agg(F.collect_set(F.struct("i", "j")).alias("m")).where(F.size("m") >= INLIERS)
    found = scratch.cut(_linked(near.select("a", "b"), table))
    roots = components(found, scratch)
    named = scratch.cut(entries.join(roots, entries["img"] == roots["node"], "left").select("entry", "img", "i", F.coalesce("root", "img").alias("root")))
    scratch.drop(entries)
    links = scratch.cut(found.unionByName(_linked(_between(named, block, scratch), table)))
    roots = components(links, scratch)
    joined = scratch.cut(groups.join(roots, groups["rep"] == roots["node"], "left").select("rep", "least", "n", F.coalesce("root", "rep").alias("root")))
    names = scratch.cut(joined.groupBy("root").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("reps")))
    named = scratch.cut(join_totals(joined.select("rep", "n", "root"), names, ["root"], "reps", groups.count()).select("rep", "n", "class_id"))
    return join_totals(each, named, ["rep"], "n", each.count()).select(F.col("id").alias(key), "class_id")


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r + 1) squares, edges repeated."""
    p = np.pad(x, r + 1, mode="edge").cumsum(axis=0, dtype=np.float64).cumsum(axis=1)
    n = 2 * r + 1
    return (p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n])[: x.shape[0], : x.shape[1]]


def textures(count: int, side: int = 64, seed: int = 11) -> np.ndarray:
    """Fixed random textures, (count, side, side), of unit deviation."""
    noise = np.random.default_rng(seed).normal(size=(count, side, side))
    smooth = np.stack([_box(_box(x, 1), 1) for x in noise])
    return smooth / smooth.std(axis=(1, 2), keepdims=True)


@functools.lru_cache(maxsize=4)
def _basis(length: int, side: int) -> np.ndarray:
    return textures(length, side).reshape(length, -1)


def drawn(vector: list | None, length: int = 64, side: int = 64) -> bytes | None:
    """A grey picture of a vector: the sum of ``length`` fixed textures weighted by it; vectors of other lengths have no picture.

    The test tables hold no pictures; this makes some whose near copies are edited copies: every pixel differs a little.
    """
    if vector is None or len(vector) != length or any(x is None for x in vector):
        return None
    return encode_pgm((128 + 50 * np.array(vector, np.float64) @ _basis(length, side)).reshape(side, side))

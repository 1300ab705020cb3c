"""Merkle manifest of a dataset: one tree a group, one tree over the groups' roots, and a proof for every row.

Built bottom-up: every level is a table written to the scratch folder, whose nodes are the digests of runs of ``ARITY`` consecutive
nodes below.  Proofs are pushed top-down: a level's nodes join their parents, and each prepends its siblings to the suffix that the
parent inherited.  A task sees one run (ARITY digests) at a time; rows are numbered range by range, so no group, however large,
meets in a task, and texts are read once and never shuffled.

Defined cases: a null field counts as ``-``, any other as its UTF-8 byte count, a colon and its value; rows of a group ascend by id
(null first), equal ids by the row's digest, so repeated rows have leaves side by side; a null group comes before all others, groups ascend
by UTF-8 bytes; a group with one row has its leaf as root; one group's root is the dataset's; an empty table has no leaves and
no root; texts of any length are digested whole; columns that are not asked for are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklane.llm.shared import Scratch, crc_remainder, numbered

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
#: Steps of a proof from a row up: the digests left of the path's node in its run, and those right of it.
STEPS = "array<struct<left:string,right:string>>"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs, concatenated."""
    return F.sha2(F.concat(*inputs).cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: tuple[str, ...] = COLUMNS, **instead: Column) -> Column:
    """Digest of a row's fields in this order; instead has what stands for a column."""
    return digest(*[field(instead.get(c, F.col(f"`{c}`"))) for c in columns])


def tampered(docs: DataFrame, every: int = 3) -> Column:
    """The row's digest after A-Z of its text were lower-cased, where ``every`` divides the id's crc32; its own elsewhere.  A null id
    counts as the empty text, whose crc32 is 0."""
    changed = F.translate(F.col("text"), _UPPER, _LOWER)
    return row_digest(text=F.when(crc_remainder(F.col("doc_id"), every) == 0, changed).otherwise(F.col("text")))


@dataclass
class Manifest:
    """levels: of the groups' trees, leaves first; tops: of the tree over their roots.  Each level is a written table with tree, place
    (from 0), nodes (of that tree on that level), digest and, above the leaves, kids: the digests below."""

    levels: list[DataFrame]
    tops: list[DataFrame]
    root: str | None


def _climb(level: DataFrame, scratch: Scratch, arity: int) -> list[DataFrame]:
    """The level and all above it, until every tree has one node."""
    levels = [level]
    most = level.agg(F.max("nodes")).first()[0] or 0
    while most > 1:
        runs = levels[-1].where("nodes > 1").groupBy("tree", F.expr(f"place div {arity}").alias("place"), F.expr(f"(nodes + {arity - 1}) div {arity}").alias("nodes"))
        kids = runs.agg(F.array_sort(F.collect_list(F.struct("place", "digest"))).alias("kids")).withColumn("kids", F.col("kids.digest"))
        levels.append(scratch.cut(kids.select("tree", "place", "nodes", digest(F.array_join("kids", "")).alias("digest"), "kids")))
        most = -(-most // arity)
    return levels


def build(docs: DataFrame, scratch: Scratch, group: str = "lang", key: str = "doc_id", leaf: Column | None = None, arity: int = ARITY, **more: Column) -> Manifest:
    """Manifest of docs; more: further columns that the leaves' table carries along."""
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))  # null sorts before any group
    rows = docs.select(tree.alias("tree"), F.col(f"`{key}`").alias("key"), (row_digest() if leaf is None else leaf).alias("digest"), *[c.alias(n) for n, c in more.items()])
    rows = scratch.cut(rows.withColumn("copy", F.monotonically_increasing_id()))  # deals equal rows to ranges
    leaves = scratch.cut(numbered(rows, "tree", ["key", "digest", "copy"], scratch, "place", "nodes").drop("copy"))
    levels = _climb(leaves, scratch, arity)
    roots = [x.where("nodes = 1").select("tree", "digest") for x in levels]
    roots = scratch.cut(_union(roots).select(F.lit("").alias("tree"), F.col("tree").alias("key"), "digest"))
    tops = _climb(scratch.cut(numbered(roots, "tree", ["key"], scratch, "place", "nodes")), scratch, arity)
    top = tops[-1].where("nodes = 1").select("digest").first()
    return Manifest(levels, tops, top and top.digest)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _descend(levels: list[DataFrame], highest: DataFrame, arity: int) -> DataFrame:
    """The leaves' level with steps and subroot; highest: tree, steps and subroot of each tree's root."""
    above = None
    for level in reversed(levels):
        rooted = level.where("nodes = 1").join(highest, "tree")
        if above is None:
            above = rooted
            continue
        inherited = above.select("tree", F.col("place").alias("run"), "kids", "steps", "subroot")
        at = F.expr(f"cast(place % {arity} as int)")
        side = lambda start, size: F.array_join(F.slice("_kids", start, size), "")
        step = F.struct(side(F.lit(1), at).alias("left"), side(at + 2, F.lit(arity)).alias("right"))
        pushed = level.where("nodes > 1").withColumn("run", F.expr(f"place div {arity}")).join(inherited.withColumnRenamed("kids", "_kids"), ["tree", "run"])
        pushed = pushed.withColumn("steps", F.concat(F.array(step), "steps")).drop("run", "_kids")
        above = pushed.unionByName(rooted)
    return above


def proofs(made: Manifest, arity: int = ARITY) -> DataFrame:
    """tree, place, key, digest (of the leaf), subroot, root, steps, and the further columns of the leaves: one row a row of the dataset."""
    start = made.tops[-1].sparkSession.createDataFrame([("", None)], "tree string, subroot string").withColumn("steps", F.expr(f"cast(array() as {STEPS})"))
    tops = _descend(made.tops, start, arity).select(F.col("key").alias("tree"), "steps", F.col("digest").alias("subroot"))
    return _descend(made.levels, tops, arity).withColumn("root", F.lit(made.root).cast("string"))


def fold(leaf: Column | str, steps: Column | str) -> Column:
    """The root that a leaf and its proof give."""
    leaf = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(steps, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def proof_digest(steps: Column | str) -> Column:
    """Digest of all siblings, from the leaf to the root, left to right."""
    return digest(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""))


def audit(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 of the rows as they are, and the root that each altered leaf folds to."""
    scratch = Scratch(docs.sparkSession, "manifest")
    made = build(docs, scratch, altered=tampered(docs) if altered is None else altered)
    folded = fold("altered", "steps")
    found = proofs(made).select(F.col("key").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", proof_digest("steps").alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

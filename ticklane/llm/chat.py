"""Chat formatting: layouts are recognised by a fingerprint of their nested field paths and mapped to canonical turns.

DataFrame functions only.  A layout is declared as the field paths it needs and how turns come from them; its
fingerprint is the SHA-256 of those paths, sorted.  A table has the paths of its schema, a JSON text row those of its value.
A row fits a layout if the fingerprint of its own paths, taken over the paths that the layout names, is the layout's; of
several that fit, the one declared first is taken.  So fields nobody asked for, whatever their names, number and depth, do
not matter.

Template, per turn::

    <s>role[INST] text [/INST]</s>

In roles and texts a backslash goes before every backslash and inside every control string (after its first
character), so that no control string is left in them and unescaping is exact.

Defined cases: null text or role is empty; turns come in order of turn (null first), role and text, so repeated rows
stay; a conversation without rows does not exist; rows with a null conv_id form one conversation; an unknown layout has
null turns in the JSON form and raises for a table; a null text and malformed JSON (repeated keys, over 1,000 levels) have no
paths and null turns; an empty list of messages has no paths either; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklane.llm.shared import Scratch

# The control strings of the template.
OPEN, ASK, ANSWER, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (OPEN, ASK, ANSWER, CLOSE)

# The field paths of each layout, in order of precedence.
LAYOUTS = {
    "turn_rows": ("role", "text", "turn"),
    "messages": ("messages[].content", "messages[].role"),
    "from_value": ("conversations[].from", "conversations[].value"),
    "instruction": ("input", "instruction", "output"),
    "instruction_only": ("instruction", "output"),
    "prompt_completion": ("completion", "prompt"),
    "prompt_response": ("prompt", "response"),
}
# Other names of the canonical roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN_PATHS = sorted({p for name, paths in LAYOUTS.items() if name != "turn_rows" for p in paths})


def fingerprint(paths) -> str:
    """SHA-256 of paths, sorted, a line each."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


FINGERPRINTS = {name: fingerprint(paths) for name, paths in LAYOUTS.items()}


def field_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths of a schema; an array adds ``[]``."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def layout_of(df: DataFrame) -> str | None:
    """Name of the layout of a table."""
    found = set(field_paths(df.schema))
    return next((name for name, paths in LAYOUTS.items() if fingerprint(found & set(paths)) == FINGERPRINTS[name]), None)


def canonical_role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(names, role), role, F.lit(""))


def _pair(user: Column, answer: Column) -> Column:
    said = lambda role, text: F.struct(F.lit(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return F.array(said("user", user), said("assistant", answer))


def _listed(items: Column, role: str, text: str) -> Column:
    return F.transform(items, lambda m: F.struct(canonical_role(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text")))


def _said(get, path: str, role: str, text: str) -> Column:
    """Turns of a list of messages: structs of a table, or variants, of which other fields and kinds do no harm."""
    items = get(path, "array<variant>")
    if items is None:
        return _listed(get(path, None), role, text)
    of = lambda m, name: F.try_variant_get(m, f"$.{name}", "string")
    return _listed(F.transform(items, lambda m: F.struct(of(m, role).alias(role), of(m, text).alias(text))), role, text)


def turns_of(layout: str, get) -> Column:
    """Canonical turns, array<struct<role,text>>, of a layout; get(path, type) reads a field (None: no such type here)."""
    text = lambda name: get(name, "string")
    if layout == "messages":
        return _said(get, "messages", "role", "content")
    if layout == "from_value":
        return _said(get, "conversations", "from", "value")
    if layout == "prompt_completion":
        return _pair(text("prompt"), text("completion"))
    if layout == "prompt_response":
        return _pair(text("prompt"), text("response"))
    if layout == "instruction_only":
        return _pair(text("instruction"), text("output"))
    if layout == "instruction":
        more = text("input")
        ask = F.when(F.coalesce(more, F.lit("")) == "", text("instruction")).otherwise(F.concat(F.coalesce(text("instruction"), F.lit("")), F.lit("\n"), more))
        return _pair(ask, text("output"))
    raise ValueError(f"no nested turns in layout {layout}")


def json_paths(value: Column) -> Column:
    """Those of KNOWN_PATHS that a VARIANT has: a field of the value itself, or of an element of a list in it."""

    def has(path: str) -> Column:
        head, _, tail = path.partition("[].")
        if tail:
            return F.exists(F.try_variant_get(value, f"$.{head}", "array<variant>"), lambda m: F.try_variant_get(m, f"$.{tail}", "variant").isNotNull())
        kind = F.substring(F.schema_of_variant(F.try_variant_get(value, f"$.{head}", "variant")), 1, 5)
        return ~F.coalesce(kind, F.lit("ARRAY")).isin("OBJEC", "ARRAY")

    return F.filter(F.array(*[F.when(has(p), F.lit(p)) for p in KNOWN_PATHS]), lambda p: p.isNotNull())


def json_turns(df: DataFrame, column: str) -> DataFrame:
    """Adds fingerprint (of the known paths), layout and turns of a column of JSON texts, each parsed once."""
    had = df.columns
    df = df.withColumn("__value", F.try_parse_json(F.col(column)))
    value = F.col("__value")
    df = df.withColumn("__paths", json_paths(value))
    mark = lambda found: F.sha2(F.array_join(found, "\n"), 256)
    layout, chosen = None, None
    for name, needed in reversed(LAYOUTS.items()):
        if name != "turn_rows":
            fits = mark(F.array_intersect(F.array(*map(F.lit, needed)), F.col("__paths"))) == FINGERPRINTS[name]
            layout = F.when(fits, F.lit(name)) if layout is None else F.when(fits, F.lit(name)).otherwise(layout)
    df = df.withColumns({"fingerprint": mark(F.col("__paths")), "layout": layout})
    get = lambda path, kind: F.try_variant_get(value, f"$.{path}", kind)
    for name in LAYOUTS:
        if name != "turn_rows":
            chosen = (F.when if chosen is None else chosen.when)(F.col("layout") == name, turns_of(name, get))
    return df.withColumn("turns", chosen).select(*[c for c in had if c not in ("fingerprint", "layout", "turns")], "fingerprint", "layout", "turns")


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_rows(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows of a table in any layout; nested layouts need a conv_id column beside."""
    layout = layout_of(df)
    if layout == "turn_rows":
        return df.select(F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if layout is None:
        raise ValueError(f"unknown layout: {field_paths(df.schema)}")
    turns = turns_of(layout, lambda path, kind: None if kind == "array<variant>" else F.col(path))
    return df.select("conv_id", F.posexplode(turns).alias("turn", "_t")).select("conv_id", F.col("turn").cast("long"), "_t.role", "_t.text")


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, segments: a formatted text for each conversation.

    segments: array of (text, loss) whose texts, joined, are the formatted text; loss marks what the model is to learn.
    """
    line = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("_n", F.row_number().over(line))
    said = F.array(
        F.struct(F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(ASK + " ")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(F.col("text")).alias("text"), (F.col("role") == "assistant").alias("loss")),
        F.struct(F.lit(" " + ANSWER + CLOSE).alias("text"), F.lit(False).alias("loss")),
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_n", said.alias("said")))).alias("_all"))
    segments = F.flatten(F.transform("_all", lambda x: x["said"]))
    grouped = grouped.select("conv_id", segments.alias("segments"))
    return grouped.withColumn("formatted", F.array_join(F.transform("segments", lambda x: x["text"]), ""))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (array<struct<role,text>>) parsed from the formatted text and loss_text, what the mask covers."""
    pieces = F.split(F.col("formatted"), CLOSE, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring_index(piece, ANSWER, 1)
        role = F.substring_index(body, ASK, 1)
        start = F.length(role) + len(ASK) + 2
        text = F.substring(body, start, F.length(body) - start)
        return F.struct(unescape(F.substring(role, F.lit(len(OPEN) + 1), F.length(role))).alias("role"), unescape(text).alias("text"))

    lost = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"])), "")
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", lost)


def with_probe(conversations: DataFrame) -> DataFrame:
    """The table and conversation -1, two turns that consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    kinds = dict(conversations.select("conv_id", "turn").dtypes)
    probe = conversations.sparkSession.range(2).select(
        F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


#: A conversation with more characters stays in rows: JSON values have a size limit.
JSON_CHARS = 1 << 20


def in_layouts(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, role, text) rows as heterogeneous sources would hold them: some conversations stay rows, the others,
    by a hash of conv_id, become JSON texts of messages, of from and value pairs, or of an instruction and its output.

    Returns (rows, conv_id and json).  Conversations whose roles a layout would rename, that are very long or that do not
    have the form of a layout stay rows; a null role or text is empty.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.sum(F.length(F.coalesce("text", F.lit(""))) + F.length(F.coalesce("role", F.lit(""))) + 64)
    renamed = F.max(F.coalesce(F.col("role").isin(*ROLES), F.lit(False)))
    way = F.when(renamed | (size > JSON_CHARS), 0).otherwise(F.pmod(F.xxhash64("conv_id"), F.lit(4)))
    whole = scratch.cut(rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("_said"), way.alias("_way")))
    pair = (F.size("_said") == 2) & (F.col("_said")[0]["role"] == "user") & (F.col("_said")[1]["role"] == "assistant")
    reverse = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    messages = F.struct(F.transform("_said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages"))
    other = F.struct(F.transform("_said", lambda t: F.struct(F.coalesce(F.element_at(reverse, t["role"]), t["role"]).alias("from"), t["text"].alias("value"))).alias("conversations"))
    order = F.struct(F.col("_said")[0]["text"].alias("instruction"), F.col("_said")[1]["text"].alias("output"))
    text = F.when((F.col("_way") == 3) & pair, F.to_json(order)).when(F.col("_way") == 2, F.to_json(other)).otherwise(F.to_json(messages))
    left = whole.where("_way = 0").select("conv_id", F.explode("_said").alias("_t")).select("conv_id", "_t.*")
    return left, whole.where("_way > 0").select("conv_id", text.alias("json"))


def canonical_rows(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows in a table layout and of JSON texts (conv_id, json), turn counted within each text."""
    turns = json_turns(texts, "json").select("conv_id", F.posexplode("turns").alias("turn", "_t"))
    kind = rows.schema["turn"].dataType
    return turn_rows(rows).unionByName(turns.select("conv_id", F.col("turn").cast(kind).alias("turn"), "_t.role", "_t.text"))


def rejected(texts: DataFrame, column: str = "json") -> DataFrame:
    """The rows of texts that canonical_rows() leaves out, all columns as they are: no JSON, a layout that is not known, or null."""
    kept = texts.columns
    return json_turns(texts.withColumn("__kept", F.struct(*[F.col(f"`{c}`") for c in kept])), column).where(F.col("turns").isNull()).select(*[F.col("__kept").getField(c).alias(c) for c in kept])

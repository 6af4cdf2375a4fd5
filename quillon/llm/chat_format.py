"""Chat formatting: schema fingerprints pick declarative mappings, a template marks turns, a mask marks what is learned.

A layout is a set of nested field paths with a mapping to canonical turns (id, turn, role, text).  The fingerprint is the
hash of the known paths that a schema (of a table) or a record (of JSON text) has; paths that no layout names don't count,
so extra columns change nothing.  Everything is DataFrame code.

Template: ``### role: text</turn>\\n`` for each turn.  In roles and texts, ``\\`` becomes ``\\b``, ``</turn>`` ``\\e``, ``###``
``\\h``, and in roles ``:`` becomes ``\\c``; after a backslash stands exactly one of b, e, h, c, so it can be undone.

A conversation becomes one string, so one task holds it; conversations are dealt out by their id and nothing wider than
one conversation is ever gathered.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</turn>\n"
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """rows: columns of a table that has a row per turn.  items: (list path, role key, text key).  fields: (role, path), in turn order."""

    name: str
    paths: tuple[str, ...]
    rows: tuple[str, str, str, str] | None = None  # id, turn, role, text
    items: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)  # names that are changed


LAYOUTS = (
    Layout("turn_rows", ("conv_id", "role", "text", "turn"), rows=("conv_id", "turn", "role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Layout("from_value", ("conversations[].from", "conversations[].value"), items=("conversations", "from", "value"), roles={"human": "user", "gpt": "assistant"}),
    Layout("prompt_response", ("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", ("prompt", "response", "system"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("completion", "prompt"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction_output", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input_output", ("input", "instruction", "output"), fields=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question_answer", ("answer", "question"), fields=(("user", "question"), ("assistant", "answer"))),
    Layout("nested_dialog", ("dialog.turns[].speaker", "dialog.turns[].utterance"), items=("dialog.turns", "speaker", "utterance")),
)


def fingerprint(paths) -> int:
    """Signed 64-bit XXH64, seed 42, of the sorted paths: Spark's xxhash64 of the same string."""
    h = xxhash.xxh64_intdigest(",".join(sorted(set(paths))).encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def known_paths(layouts=LAYOUTS) -> list[str]:
    return sorted({p for x in layouts for p in x.paths})


def schema_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Leaf paths of a Spark schema, ``a.b`` for fields and ``a[]`` for elements."""
    if isinstance(schema, T.StructType):
        return [p for f in schema for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return schema_paths(schema.elementType, at + "[]")
    return [at]


def layout_of_schema(schema: T.StructType, layouts=LAYOUTS) -> Layout:
    """The layout whose fingerprint the schema's known paths have; else the largest one that the schema holds whole.

    Raises ValueError where no layout fits.
    """
    have = set(schema_paths(schema)) & set(known_paths(layouts))
    by = {fingerprint(x.paths): x for x in layouts}
    found = by.get(fingerprint(have)) or max((x for x in layouts if set(x.paths) <= have), key=lambda x: len(x.paths), default=None)
    if found is None:
        raise ValueError(f"no layout has the paths {sorted(have)}")
    return found


def turns_of_table(table: DataFrame, id_column: str = "conv_id", layouts=LAYOUTS) -> DataFrame:
    """Canonical turns (id, turn, role, text) of a typed table, by its schema's fingerprint.

    Null roles and texts count as empty.  Tables with a row per record get the turn's place as turn.
    """
    layout = layout_of_schema(table.schema, layouts)
    if layout.rows:
        key, turn, role, text = layout.rows
        return table.select(F.col(key).alias("id"), F.col(turn).cast("bigint").alias("turn"), clean_role(F.col(role), layout), F.coalesce(text, F.lit("")).alias("text"))
    if layout.items:
        path, role, text = layout.items
        made = F.transform(F.col(path), lambda x, i: F.struct(i.cast("bigint").alias("turn"), x[role].alias("role"), x[text].alias("text")))
    else:
        made = F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.col(p).cast("string").alias("text")) for i, (r, p) in enumerate(layout.fields)])
    rows = table.select(F.col(id_column).alias("id"), F.explode(made).alias("t"))
    return rows.select("id", "t.turn", clean_role(F.col("t.role"), layout), F.coalesce("t.text", F.lit("")).alias("text"))


def clean_role(role: Column, layout: Layout) -> Column:
    out = F.coalesce(role, F.lit(""))
    for a, b in layout.roles.items():
        out = F.when(role == a, b).otherwise(out)
    return out.alias("role")


def numbered(items: Column, layout: Layout) -> Column:
    """Turns of an array of messages."""
    _, role, text = layout.items
    return F.transform(items, lambda t, i: F.struct(i.cast("bigint").alias("turn"), clean_role(t[role], layout), F.coalesce(t[text], F.lit("")).alias("text")))


def turns_of_json(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """Canonical turns (id, turn, role, text, layout) of records (id, record: JSON text) of any mixture of layouts.

    Each record's fingerprint is that of the known paths it has.  A record that isn't JSON or that no layout fits keeps one
    row with layout, turn, role and text null, so it can be counted and looked at.
    """
    layouts = [x for x in layouts if not x.rows]
    at = lambda p: "$." + p.replace("[]", "[0]")
    v = F.col("v")
    has = [F.when(F.try_variant_get(v, at(p), "variant").isNotNull(), F.lit(p)) for p in known_paths(layouts)]
    parsed = records.select("id", F.try_parse_json("record").alias("v")).withColumn("fp", F.xxhash64(F.array_join(F.filter(F.array(*has), lambda p: p.isNotNull()), ",")))
    made, name = F.lit(None).cast(TURNS), F.lit(None).cast("string")
    for x in layouts:
        if x.items:
            path, role, text = x.items
            got = F.try_variant_get(v, at(path), f"array<struct<`{role}`:string,`{text}`:string>>")
            turns = numbered(got, x)
        else:
            turns = F.array(*[F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.coalesce(F.try_variant_get(v, at(p), "string"), F.lit("")).alias("text")) for i, (r, p) in enumerate(x.fields)])
        fits = F.col("fp") == fingerprint(x.paths)
        made, name = F.when(fits, turns).otherwise(made), F.when(fits, x.name).otherwise(name)
    return parsed.select("id", name.alias("layout"), F.explode_outer(made).alias("t")).select("id", "t.turn", "t.role", "t.text", "layout")


def escape(c: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("</turn>"), F.lit("\\e")), F.lit("###"), F.lit("\\h"))
    return F.replace(out, F.lit(":"), F.lit("\\c")) if role else out


def unescape(c: Column, role: bool = False) -> Column:
    if role:
        c = F.replace(c, F.lit("\\c"), F.lit(":"))
    return F.replace(F.replace(F.replace(c, F.lit("\\h"), F.lit("###")), F.lit("\\e"), F.lit("</turn>")), F.lit("\\b"), F.lit("\\"))


def format_turns(turns: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row per id: formatted (string) and loss_mask, array of (turn: its place from 0, start, end: code points from the
    turn's first one on), the escaped texts of the learned roles.

    Turns stand in the order of turn, then role, then text, nulls first; repeated rows are kept as turns of their own.
    Null ids are one conversation.
    """
    head, text = F.concat(F.lit("### "), escape(F.col("role"), True), F.lit(": ")), escape(F.col("text"))
    piece = F.struct("turn", "role", "text", head.alias("head"), text.alias("body"))
    rows = turns.select("id", piece.alias("piece")).groupBy("id").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    start = lambda p: F.char_length(p["head"])
    spans = F.transform("pieces", lambda p, i: F.struct(i.alias("turn"), start(p).alias("start"), (start(p) + F.char_length(p["body"])).alias("end"), p["role"].isin(*learned).alias("on")))
    mask = F.transform(F.filter(spans, lambda s: s["on"]), lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.select("id", formatted.alias("formatted"), mask.alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds to formatted conversations, from the string and the mask alone: turns (array of role, text) and loss_text."""
    pieces = F.filter(F.split("formatted", END), lambda p: p != "")
    role = lambda p: unescape(F.substring_index(F.substr(p, F.lit(5)), ": ", 1), True)
    text = lambda p: unescape(F.substr(p, F.instr(p, ": ") + 2))
    turns = F.transform("_pieces", lambda p: F.struct(role(p).alias("role"), text(p).alias("text")))
    learned = F.transform("loss_mask", lambda s: unescape(F.substr(F.get(F.col("_pieces"), s["turn"]), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumn("_pieces", pieces).withColumn("turns", turns).withColumn("loss_text", F.array_join(learned, "")).drop("_pieces")


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation what was read back: counts and digests."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        F.col("id").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )

"""Chat formatting: schema fingerprints select declarative mappings. DataFrame functions only.

A record's nested field paths, without their types, are its skeleton; the
skeleton's hash is the fingerprint. A mapping says where a layout keeps its
turns. Canonical turns go through a template that escapes its own control
strings, so that formatted text can be read back exactly.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

START, END = "<|im_start|>", "<|im_end|>\n"
NEWLINE = "<|nl|>"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """skeleton: nested field names in order of code points. Either a list of messages, or one field or more for each turn."""

    name: str
    skeleton: str
    messages: str | None = None
    role: str | None = None
    text: str | None = None
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.skeleton.encode()).hexdigest()


LAYOUTS = (
    Layout("message", "OBJECT<role, text>", role="role", text="text"),
    Layout("message-content", "OBJECT<content, role>", role="role", text="content"),
    Layout("row-from-value", "OBJECT<from, value>", role="from", text="value"),
    Layout("no-messages", "OBJECT<messages: ARRAY<>>", "messages", "role", "content"),
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", "messages", "role", "content"),
    Layout("turns", "OBJECT<turns: ARRAY<OBJECT<role, text>>>", "turns", "role", "text"),
    Layout("from-value", "OBJECT<conversations: ARRAY<OBJECT<from, value>>>", "conversations", "from", "value"),
    Layout("prompt-completion", "OBJECT<completion, prompt>", turns=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt-response", "OBJECT<prompt, response>", turns=(("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", "OBJECT<instruction, output>", turns=(("user", ("instruction",)), ("assistant", ("output",)))),
    Layout("instruction-input", "OBJECT<input, instruction, output>", turns=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("system-prompt", "OBJECT<prompt, response, system>", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
)
#: Names of roles in other layouts.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


#: Fields of single messages that no mapping reads; a record is of the same layout with and without them.
ASIDE = ("name", "weight")


def skeleton(record: Column) -> Column:
    """Field names and nesting of a VARIANT record, without types and without the fields ASIDE of listed messages."""
    bare = F.regexp_replace(F.schema_of_variant(record), r"(?:: |(?<=ARRAY<))(?!OBJECT|ARRAY)[A-Z_]+(\([0-9, ]*\))?", "")
    for name in ASIDE:
        bare = F.regexp_replace(bare, rf"(?<=ARRAY<OBJECT<)((?:\w+, )*?){name}, |(?<=ARRAY<OBJECT<)((?:\w+, )*?\w+), {name}(?=>)", "$1$2")
    return bare


def fingerprint(record: Column) -> Column:
    return F.sha2(skeleton(record), 256)


def _role(col: Column) -> Column:
    out = F.coalesce(col, F.lit(""))
    for other, role in ROLES.items():
        out = F.when(col == other, role).otherwise(out)
    return out


def _mapped(record: Column, layout: Layout) -> Column:
    kind = f"struct<`{layout.role}`:string,`{layout.text}`:string>"
    turn = lambda m: F.struct(_role(m[layout.role]).alias("role"), F.coalesce(m[layout.text], F.lit("")).alias("text"))
    if layout.messages:
        return F.transform(F.variant_get(record, f"$.{layout.messages}", f"array<{kind}>"), turn)
    if layout.role:
        return F.array(turn(F.variant_get(record, "$", kind)))
    text = lambda f: F.coalesce(F.variant_get(record, f"$.{f}", "string"), F.lit(""))
    joined = lambda fields: text(fields[0]) if len(fields) == 1 else F.array_join(F.filter(F.array(*map(text, fields)), lambda x: x != ""), "\n\n")
    return F.array(*(F.struct(F.lit(role).alias("role"), joined(fields).alias("text")) for role, fields in layout.turns))


def canonical(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The rows with layout and turns instead of the record, a JSON string or VARIANT.

    A record of unknown layout, a null one and one that is not JSON keep their
    row; layout and turns are null. Null roles and texts become empty strings.
    An empty table gives an empty result; columns layout and turns of the input
    are replaced, other extra columns are kept.
    """
    kind = dict(records.dtypes)[record]
    parsed = records.withColumn("__v", F.col(record) if kind == "variant" else F.try_parse_json(record)).withColumn("__f", fingerprint(F.col("__v")))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for x in layouts:
        name = F.when(F.col("__f") == x.fingerprint, x.name).otherwise(name)
        turns = F.when(F.col("__f") == x.fingerprint, _mapped(F.col("__v"), x)).otherwise(turns)
    return parsed.withColumn("layout", name).withColumn("turns", turns).drop("__v", "__f", record)


def escape(text: Column) -> Column:
    """No escaped text holds '<|'; a backslash is doubled."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, r"\\([\\|])", "$1")).otherwise(text)


def segments(turns: Column, trained: str = "assistant") -> Column:
    """The formatted text in pieces, each inside or outside the loss mask."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    head = lambda t: F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    return F.flatten(F.transform(turns, lambda t: F.array(piece(head(t), F.lit(False)), piece(escape(t["text"]), t["role"] == trained), piece(F.lit(END), F.lit(False)))))


def loss_spans(pieces: Column) -> Column:
    """turn, start, length of each stretch under the loss mask: start counts code points from the beginning of its turn.

    Segments come as three to a turn: head, text and end.
    """

    def spans(pieces):
        turns = F.when(F.size(pieces) > 0, F.sequence(F.lit(0), F.floor(F.size(pieces) / 3).cast("int") - 1)).otherwise(F.array().cast("array<int>"))
        at = lambda i, k: F.get(pieces, i * 3 + k)
        found = F.transform(turns, lambda i: F.struct(i.alias("turn"), F.length(at(i, 0)["text"]).alias("start"), F.length(at(i, 1)["text"]).alias("length"), at(i, 1)["loss"].alias("loss")))
        return F.filter(found, lambda s: s["loss"])

    return let(pieces, spans)


def cut(text: Column, spans: Column) -> Column:
    """The stretches of a formatted text that loss_spans() names, unescaped, one after another. Turns are cut one by one, so work is linear."""
    return let(turn_parts(text), lambda parts: F.array_join(F.transform(spans, lambda s: unescape(F.substr(F.get(parts, s["turn"]), s["start"] + 1, s["length"]))), ""))


def turn_parts(text: Column) -> Column:
    return F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")


def formatted(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: the inverse of the template."""

    def turn(p):
        role = F.substring_index(p, "\n", 1)
        return F.struct(
            unescape(F.replace(F.substr(role, F.lit(len(START) + 1)), F.lit(NEWLINE), F.lit("\n"))).alias("role"),
            unescape(F.substr(p, F.length(role) + 2)).alias("text"),
        )

    return F.transform(turn_parts(text), turn)


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id, unknown, turns, pieces, formatted from rows (conv_id, turn, layout, turns); unknown counts rows without turns.

    Rows are ordered by turn, nulls first, then by role and text, so repeated
    rows are repeated turns. A null conv_id is a conversation like others. A
    conversation is gathered in one task, as its digest and its text are one
    value. Rows without turns add none. An empty table gives an empty result.
    """
    turns = rows.select("conv_id", "turn", F.posexplode_outer("turns").alias("k", "t"))
    of = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "k", "t.role", "t.text"))).alias("x"), F.count_if(F.col("t").isNull()).alias("unknown"))
    of = of.select("conv_id", "unknown", F.transform(F.filter("x", lambda x: x["role"].isNotNull()), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    return of.withColumn("pieces", segments(F.col("turns"))).withColumn("formatted", formatted(F.col("pieces")))

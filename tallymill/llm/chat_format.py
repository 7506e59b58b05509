"""Chat records of many layouts to one marked text, in DataFrame functions alone (operator 6).

The nested field paths of a record are hashed; the fingerprint selects a declarative mapping to turns (role, text). A
record is JSON text, whose paths are its own, or a struct, whose paths are its schema's; a table with one turn a row is
first nested to one such struct for each conversation. Turns are written `### role: text</turn>` with the signs that marks are made of escaped, so the text
can be split back exactly; a loss mask holds the byte spans of what assistants say.

Defined results: null texts and null roles are empty; turns go by turn number, then role, then text, null numbers
first; repeated rows are turns of their own; a conversation with a null id is one conversation; records of an unknown
layout have a null layout and no turns; where paths of several layouts are there, the one with most paths is taken;
an empty table gives an empty one; further columns and fields do not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_names

#: Marks of the template, and what stands for the signs they are made of.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
COLON_ESCAPE = (":", "\\c")
TURNS = "array<struct<role:string,text:string>>"


def escape(x: Column, role: bool = False) -> Column:
    for plain, coded in (*ESCAPES, *((COLON_ESCAPE,) if role else ())):
        x = F.replace(x, F.lit(plain), F.lit(coded))
    return x


def unescape(x: Column, role: bool = False) -> Column:
    for plain, coded in (*((COLON_ESCAPE,) if role else ()), *ESCAPES[::-1]):
        x = F.replace(x, F.lit(coded), F.lit(plain))
    return x


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


@dataclass(frozen=True)
class Listed:
    """A layout with a list of turns: names of the list and of its fields; `order` numbers the turns, `rename` makes roles canonical."""

    items: str
    role: str
    text: str
    order: str | None = None
    rename: bool = True

    def paths(self) -> list[str]:
        return [f"{self.items}[].{f}" for f in (self.role, self.text, self.order) if f]


@dataclass(frozen=True)
class Asked:
    """A layout with one question and its answer, perhaps with what the system says and more context for the question."""

    question: str
    answer: str
    system: str | None = None
    context: str | None = None

    def paths(self) -> list[str]:
        return [f for f in (self.question, self.answer, self.system, self.context) if f]


LAYOUTS = {
    "prompt_response": Asked("prompt", "response"),
    "prompt_completion": Asked("prompt", "completion"),
    "instruction": Asked("instruction", "output"),
    "question_answer": Asked("question", "answer"),
    "system_prompt_response": Asked("prompt", "response", system="system"),
    "instruction_input": Asked("instruction", "output", context="input"),
    "turns": Listed("turns", "role", "text"),
    "conversations": Listed("conversations", "from", "value"),
    "messages": Listed("messages", "role", "content"),
    "turn_rows": Listed("turns", "role", "text", order="turn", rename=False),
    "content_rows": Listed("turns", "role", "content", order="index", rename=False),
}
#: Other names of the canonical roles.
ROLES = {"human": "user", "user": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "assistant": "assistant", "system": "system"}


class _Json:
    """Fields and paths of a variant."""

    def __init__(self, v: Column):
        self.v = v
        none = F.array().cast("array<string>")
        fields = F.from_json(F.to_json(v), "map<string,variant>")
        names = lambda items: F.flatten(F.transform(items, lambda x: F.coalesce(F.json_object_keys(F.to_json(x)), none)))
        items = lambda x: F.try_variant_get(x, "$", "array<variant>")
        each = F.transform(F.coalesce(F.map_keys(fields), none), lambda k: F.coalesce(F.transform(names(items(fields[k])), lambda n: F.concat(k, F.lit("[]."), n)), F.array(k)))
        self.paths = F.flatten(each)

    def text(self, name: str) -> Column:
        return F.try_variant_get(self.v, f"$.{name}", "string")

    def turns(self, layout: Listed) -> Column:
        number = f",{layout.order}:bigint" if layout.order else ""
        return F.try_variant_get(self.v, f"$.{layout.items}", f"array<struct<{layout.role}:string,{layout.text}:string{number}>>")


class _Fields:
    """Fields and paths of a struct, by its schema."""

    def __init__(self, column: Column, schema: T.StructType):
        self.column, self.known = column, set()
        for f in schema.fields:
            inner = f.dataType.elementType if isinstance(f.dataType, T.ArrayType) else None
            self.known |= {f"{f.name}[].{g.name}" for g in inner.fields} if isinstance(inner, T.StructType) else {f.name}
        self.paths = F.array(*map(F.lit, sorted(self.known))).cast("array<string>")

    def text(self, name: str) -> Column:
        return self.column[name].cast("string") if name in self.known else F.lit(None).cast("string")

    def turns(self, layout: Listed) -> Column:
        fields = [(layout.role, "string"), (layout.text, "string"), *([(layout.order, "bigint")] if layout.order else [])]
        if not set(layout.paths()) <= self.known:
            return F.lit(None).cast(f"array<struct<{','.join(f'{f}:{t}' for f, t in fields)}>>")
        return F.transform(self.column[layout.items], lambda m: F.struct(*[m[f].cast(t).alias(f) for f, t in fields]))


def _read(record: _Json | _Fields, layout: Listed | Asked) -> Column:
    """The turns that a layout's mapping gives for a record."""
    if isinstance(layout, Listed):
        each = record.turns(layout)
        if layout.order:
            number = lambda m: F.struct(m[layout.order].alias("turn"), _turn(m[layout.role], m[layout.text])["role"].alias("role"), _turn(m[layout.role], m[layout.text])["text"].alias("text"))
            return F.transform(F.array_sort(F.transform(each, number)), lambda m: _turn(m["role"], m["text"]))
        names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        role = (lambda r: F.coalesce(names[F.lower(r)], r)) if layout.rename else (lambda r: r)
        return F.transform(each, lambda m: _turn(role(m[layout.role]), m[layout.text]))
    user = record.text(layout.question)
    if layout.context:
        more = record.text(layout.context)
        user = F.when(F.coalesce(more, F.lit("")) == "", user).otherwise(F.concat_ws("\n", user, more))
    parts = [_turn(F.lit("user"), user), _turn(F.lit("assistant"), record.text(layout.answer))]
    if layout.system:
        head = record.text(layout.system)
        return F.when(head.isNull(), F.array(*parts)).otherwise(F.array(_turn(F.lit("system"), head), *parts))
    return F.array(*parts)


def fingerprint(paths: Column) -> Column:
    """Hash of an array of nested field paths, whatever their order."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def canonical(records: DataFrame, column: str = "record") -> DataFrame:
    """The records (JSON text or a struct) with fingerprint, layout and turns.

    The fingerprint is that of the paths that some layout uses; ids, sources and the like do not count. A layout is
    selected where the paths it has in common with the record hash to its own fingerprint.
    """
    kind = records.schema[column].dataType
    record = _Fields(F.col(column), kind) if isinstance(kind, T.StructType) else _Json(F.try_parse_json(F.col(column).cast("string")))
    of = lambda paths: F.array(*map(F.lit, sorted(paths)))
    used = {p for layout in LAYOUTS.values() for p in layout.paths()}
    out = records.withColumn("fingerprint", fingerprint(F.array_intersect(record.paths, of(used))))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for key, layout in sorted(LAYOUTS.items(), key=lambda x: len(x[1].paths())):
        is_it = fingerprint(F.array_intersect(record.paths, of(layout.paths()))) == fingerprint(of(layout.paths()))
        name = F.when(is_it, F.lit(key)).otherwise(name)
        turns = F.when(is_it, _read(record, layout).cast(TURNS)).otherwise(turns)
    return out.withColumns({"layout": name, "turns": turns})


def from_rows(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, fingerprint, layout, turns) of a table with one turn a row: its rows are nested under `turns`, and `canonical` reads that record."""
    used = {p for layout in LAYOUTS.values() for p in layout.paths()}
    fields = [c for c in rows.columns if c != key and f"turns[].{c}" in used]
    if key not in rows.columns or not fields:
        raise ValueError(f"no layout for the columns {rows.columns}")
    nested = rows.groupBy(F.col(key).cast("long").alias("conv_id")).agg(F.struct(F.collect_list(F.struct(*[F.col(c) for c in fields])).alias("turns")).alias("record"))
    return canonical(nested).drop("record")


def formatted(conversations: DataFrame) -> DataFrame:
    """The conversations with `formatted` and `loss_spans` (start and size in bytes of what assistants say)."""
    heads = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"], True), F.lit(COLON)))
    bodies = F.transform("turns", lambda t: escape(t["text"]))
    head, body, size = fresh_names(conversations.columns, "heads", "bodies", "sizes")
    out = conversations.withColumns({head: heads, body: bodies})
    whole = F.array_join(F.zip_with(head, body, lambda h, b: F.concat(h, b, F.lit(CLOSE))), "")
    sizes = F.zip_with(head, body, lambda h, b: F.struct(F.octet_length(h).cast("long").alias("h"), F.octet_length(b).cast("long").alias("b")))
    out = out.withColumns({"formatted": whole, size: F.zip_with(sizes, "turns", lambda s, t: F.struct(s["h"].alias("h"), s["b"].alias("b"), (t["role"] == "assistant").alias("on")))})
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,size:bigint>>").alias("spans"))
    add = lambda a, s: F.struct((a["at"] + s["h"] + s["b"] + len(CLOSE)).alias("at"), F.when(s["on"], F.concat(a["spans"], F.array(F.struct((a["at"] + s["h"]).alias("start"), s["b"].alias("size"))))).otherwise(a["spans"]).alias("spans"))
    return out.withColumn("loss_spans", F.aggregate(size, empty, add)["spans"]).drop(head, body, size)


def read_back(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted) from `formatted` and `loss_spans` alone."""
    pieces = F.filter(F.split("formatted", CLOSE), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), COLON, 1), True).alias("role"), unescape(F.substr(p, F.lit(len(OPEN) + 1) + F.length(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), COLON, 1)) + len(COLON))).alias("text")))
    raw = F.encode("formatted", "UTF-8")
    said = F.transform("loss_spans", lambda s: unescape(F.decode(F.substr(raw, (s["start"] + 1).cast("int"), s["size"].cast("int")), "UTF-8")))
    return conversations.select("conv_id", turns.alias("turns"), F.array_join(said, "").alias("loss_text"), "formatted")


def digests(conversations: DataFrame) -> DataFrame:
    back = read_back(conversations)
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines.cast("binary"), 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))

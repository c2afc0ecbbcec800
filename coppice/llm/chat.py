"""Chat formatting: records of many layouts become canonical turns, then marked text with a loss mask.

A record's fingerprint is a hash of its nested field paths (``messages[].role``), sorted, as far as any
layout knows them. The fingerprint selects a declarative layout that says where roles and texts stand.
Frames are fingerprinted by their schema when the plan is made; JSON records, and frames whose schema fits no
layout alone, row by row from the fields that are present. If the fingerprint is unknown, the first
layout all of whose paths are present is taken; ``unmapped`` returns the rows that fit none.

Each turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts a backslash is
doubled and ``\\-`` follows the first character of every control string, so that none is left; reading back
undoes both in one pass. Line ends in roles are written ``\\n``.

A conversation is cut into segments by its turn numbers, SEGMENT numbers each, so that a conversation
with a large share of all rows is formatted by many tasks. Only a digest, which is a hash over
one whole conversation, gathers the segments of one, and only for conversations that have several.

Everything is a DataFrame function. Defined cases: a null text or role is empty; a null conversation is a
conversation of its own; turns without a number come last; equal numbers go by role, then text; repeated rows
are turns each; columns that no layout knows, whatever their names, are ignored; a record without any turn
yields no turn; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm.common import settle

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that common chat templates give a meaning.
CONTROL = [START, END, "<|endoftext|>", "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
SEGMENT = 64
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns.

    ``array`` with ``role`` and ``text`` names a list of messages; ``pairs`` a list of question and answer
    pairs that come first; ``turns`` gives (role, field, ...), fields being joined by blank lines.
    """

    name: str
    turns: tuple[tuple[str, ...], ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""
    pairs: str = ""
    optional: tuple[str, ...] = ()
    rows: tuple[str, ...] = field(default=())

    def paths(self) -> list[str]:
        own = [f for t in self.turns for f in t[1:]] + list(self.rows)
        return own + ([f"{self.array}[].{self.role}", f"{self.array}[].{self.text}"] if self.array else []) + ([f"{self.pairs}[][]"] if self.pairs else [])

    def required(self) -> list[str]:
        return [p for p in self.paths() if p not in self.optional]


ROWS = Layout("turn_rows", rows=("conv_id", "turn", "role", "text"))
LAYOUTS = [
    Layout("messages", array="messages", role="role", text="content", turns=(("system", "system"),), optional=("system",)),
    Layout("from_value", array="conversations", role="from", text="value", turns=(("system", "system"),), optional=("system",)),
    Layout("dialogue", array="dialogue", role="speaker", text="utterance"),
    Layout("instruction", turns=(("system", "system"), ("user", "instruction", "input"), ("assistant", "output")), optional=("system", "input")),
    Layout("history", pairs="history", turns=(("system", "system"), ("user", "query"), ("assistant", "response")), optional=("system",)),
    Layout("query_response", turns=(("system", "system"), ("user", "query"), ("assistant", "response")), optional=("system",)),
    Layout("prompt_completion", turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("prompt_response", turns=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question_answer", turns=(("user", "context", "question"), ("assistant", "answer")), optional=("context",)),
]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def fingerprints(layouts: list[Layout] = LAYOUTS) -> dict[str, str]:
    """Fingerprint to layout, with every choice of optional fields."""
    out: dict[str, str] = {}
    for m in layouts:
        for some in chain.from_iterable(combinations(m.optional, n) for n in range(len(m.optional) + 1)):
            out.setdefault(fingerprint(m.required() + list(some)), m.name)
    return out


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """Nested field paths of a type: ``a``, ``a.b``, ``a[]``, ``a[].b``."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def record_schema(layouts: list[Layout] = LAYOUTS) -> T.StructType:
    """A struct with every field that a layout knows."""
    fields: dict[str, T.DataType] = {}
    for m in layouts:
        if m.array:
            fields[m.array] = T.ArrayType(T.StructType([T.StructField(m.role, T.StringType()), T.StructField(m.text, T.StringType())]))
        if m.pairs:
            fields[m.pairs] = T.ArrayType(T.ArrayType(T.StringType()))
        fields |= {f: T.StringType() for t in m.turns for f in t[1:]}
    return T.StructType([T.StructField(k, v) for k, v in sorted(fields.items())])


def _present(rec: Column, path: str) -> Column:
    """Whether a record holds a path, in any element of its list."""
    if path.endswith("[][]"):
        return rec[path[:-4]].isNotNull()
    if "[]." in path:
        head, tail = path.split("[].")
        return F.coalesce(F.exists(rec[head], lambda m: m[tail].isNotNull()), F.lit(False))
    return rec[path].isNotNull()


def row_fingerprint(rec: Column, layouts: list[Layout] = LAYOUTS) -> tuple[Column, Column]:
    """The sorted known paths that a record holds, and their hash."""
    known = sorted({p for m in layouts for p in m.paths()})
    held = F.filter(F.array(*[F.when(_present(rec, p), F.lit(p)) for p in known]), lambda p: p.isNotNull())
    return held, F.substring(F.sha2(F.array_join(held, "\n"), 256), 1, 16)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _named(role: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), role), role)


def _turns_of(rec: Column, m: Layout) -> Column:
    """A layout's turns as an array of (role, text), in order."""

    def said(t: tuple[str, ...]) -> Column:
        held = reduce(lambda a, b: a | b, [rec[f].isNotNull() for f in t[1:]])
        return F.when(held, F.array(_turn(F.lit(t[0]), F.concat_ws("\n\n", *[rec[f] for f in t[1:]])))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))

    first = [said(t) for t in m.turns if t[0] == "system"]
    last = [said(t) for t in m.turns if t[0] != "system"]
    mid = []
    if m.array:
        mid = [F.transform(F.filter(rec[m.array], lambda x: x.isNotNull()), lambda x: _turn(_named(x[m.role]), x[m.text]))]
    if m.pairs:
        both = F.flatten(F.transform(F.filter(rec[m.pairs], lambda p: p.isNotNull()), lambda p: F.transform(p, lambda x, i: _turn(F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")), x))))
        mid = [F.coalesce(both, F.array().cast("array<struct<role:string,text:string>>"))]
    return F.concat(*first, *mid, *last)


def _records(df: DataFrame, id_col: str, record: Column, layouts: list[Layout]) -> DataFrame:
    """conv_id, layout and turns of one record a row; the layout is null where none fits."""
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("conv_id"), record.alias("rec"))
    held, mark = row_fingerprint(F.col("rec"), layouts)
    rows = rows.withColumn("held", held).withColumn("fingerprint", mark)
    by_mark = F.create_map(*[F.lit(x) for kv in fingerprints(layouts).items() for x in kv])
    fits = F.coalesce(*[F.when(F.size(F.array_except(F.array(*[F.lit(p) for p in m.required()]), F.col("held"))) == 0, F.lit(m.name)) for m in layouts])
    rows = rows.withColumn("layout", F.coalesce(F.element_at(by_mark, F.col("fingerprint")), fits))
    turns = F.coalesce(*[F.when(F.col("layout") == m.name, _turns_of(F.col("rec"), m)) for m in layouts])
    return rows.withColumn("turns", turns).drop("rec", "held")


def _as_record(df: DataFrame, json_col: str | None, layouts: list[Layout]) -> Column:
    want = record_schema(layouts)
    if json_col:
        return F.from_json(F.col(f"`{json_col}`"), want)
    have = {f.name: f.dataType for f in df.schema.fields}
    fits = {f.name: f.name in have and set(schema_paths(f.dataType, f.name)) <= set(schema_paths(have[f.name], f.name)) for f in want.fields}
    return F.struct(*[(_cast(f"`{f.name}`", f.dataType) if fits[f.name] else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields])


def _cast(name: str, kind: T.DataType) -> Column:
    """A column reduced to the fields a layout knows, found by name."""
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(F.col(name), lambda x: F.when(x.isNotNull(), F.struct(*[x[f.name].cast(f.dataType).alias(f.name) for f in kind.elementType.fields])))
    return F.col(name).cast(kind)


def canonical_turns(df: DataFrame, id_col: str = "conv_id", json_col: str | None = None, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text of every record that fits a layout."""
    if json_col is None:
        known = {p for m in [ROWS, *layouts] for p in m.paths()}
        paths = [p for p in schema_paths(df.schema) if p in known]
        if fingerprint(paths) == fingerprint(ROWS.paths()) or set(ROWS.required()) <= set(paths):
            return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    rows = _records(df, id_col, _as_record(df, json_col, layouts), layouts)
    return rows.select("conv_id", F.posexplode("turns").alias("turn", "t")).select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def unmapped(df: DataFrame, id_col: str = "conv_id", json_col: str | None = None, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """conv_id and fingerprint of the records that fit no layout, malformed JSON included."""
    return _records(df, id_col, _as_record(df, json_col, layouts), layouts).filter("layout is null").select("conv_id", "fingerprint")


def escape(text: Column) -> Column:
    first = "|".join(f"{re.escape(c)}(?={'|'.join(_quoted(s[1:]) for s in CONTROL if s[0] == c)})" for c in sorted({s[0] for s in CONTROL}))
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), first, "$0\\\\-")


def _quoted(s: str) -> str:
    return re.sub(r"([\\|\[\]<>/])", r"\\\1", s)


def unescape(text: Column) -> Column:
    """One pass from the left: a doubled backslash becomes one, a mark after a control character goes."""
    return F.regexp_replace(text, r"\\(?:-|(\\))", "$1")


def _role_in(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _role_out(role: Column) -> Column:
    # the backslash of a line end's mark follows an even number of others
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, segment, formatted and loss: spans (start, length) of code points that are trained on."""
    row = F.struct(F.col("turn").isNull().alias("late"), "turn", _role_in(F.col("role")).alias("role"), escape(F.col("text")).alias("text"))
    got = turns.groupBy("conv_id", F.floor(F.col("turn") / SEGMENT).alias("segment")).agg(F.array_sort(F.collect_list(row)).alias("t"))
    head = len(START) + 1
    tail = len(END) + 1
    none = F.array().cast("array<struct<start:int,length:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + head + F.length(x["role"])
        n = F.length(x["text"])
        here = F.when(x["role"] == loss_role, F.array(F.struct(start.alias("start"), n.alias("length")))).otherwise(none)
        return F.struct((start + n + tail).alias("at"), F.concat(acc["spans"], here).alias("spans"))

    spans = F.aggregate("t", F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    text = F.array_join(F.transform("t", lambda x: F.concat(F.lit(START), x["role"], F.lit("\n"), x["text"], F.lit(END + "\n"))), "")
    return got.select("conv_id", "segment", text.alias("formatted"), spans.alias("loss"))


def write_chats(chats: DataFrame) -> DataFrame:
    """Write formatted segments to the shared folder and read them back."""
    return settle(chats, codec="zstd")


def parse(formatted: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, _quoted(END) + "\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.instr(p, "\n")
        role = F.substring(p, F.lit(len(START) + 1), at - len(START) - 1)
        return F.struct(_role_out(role).alias("role"), unescape(F.substring(p, at + 1, F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def masked(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted segments say, conversation by conversation."""
    said = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    parts = chats.select("conv_id", "segment", F.size(said).alias("n"), F.array_join(said, "").alias("turns"), masked(F.col("formatted"), F.col("loss")).alias("loss"), F.length("formatted").alias("chars"))
    several = chats.groupBy(F.col("conv_id").alias("_id")).count().filter("count > 1").select("_id")
    same = F.col("conv_id").eqNullSafe(F.col("_id"))
    whole = parts.join(several, same, "left_anti").select("conv_id", "n", "turns", "loss", "chars")
    rest = parts.join(several, same, "left_semi").groupBy("conv_id").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("segment").isNull().alias("late"), "segment", "turns", "loss"))).alias("p"), F.sum("chars").alias("chars")
    )
    rest = rest.select("conv_id", "n", F.array_join("p.turns", "").alias("turns"), F.array_join("p.loss", "").alias("loss"), "chars")
    return whole.unionByName(rest).select(
        "conv_id",
        F.col("n").cast("long").alias("n_turns"),
        F.sha2(F.col("turns"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.col("chars").cast("long").alias("formatted_chars"),
    )

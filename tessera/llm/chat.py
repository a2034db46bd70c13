"""Chat formatting: layouts are told by a fingerprint of their field paths and turned into canonical turns.

A mapping says, for one layout (a set of nested field paths with their types), how to get an array of (role, text) turns
by a column expression. The fingerprint of a table's own paths selects the mapping; nothing is guessed from rows.
Turns become one string with marked turns; control strings inside texts are escaped so that they can be read back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Control strings of the template. A turn the model learns from stands in the second pair, others in the first.
OPEN, CLOSE, LEARN_OPEN, LEARN_CLOSE, ROLE_END = "[INST]", "[/INST]", "<s>", "</s>", "[/ROLE]"
CONTROL = r"([\[<])(/?(?:INST\]|ROLE\]|s>))"


def paths(schema: T.DataType, at: str = "") -> list[str]:
    """All leaf field paths of a schema with their kind, lists marked by []; whole and decimal number widths are one kind."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, f"{at}[]")
    kind = "number" if isinstance(schema, T.NumericType) else schema.typeName()
    return [f"{at}:{kind}"]


def fingerprint(field_paths: list[str]) -> str:
    """Hash of a layout: the order of its fields doesn't matter."""
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


#: Names of roles in other layouts; others stay as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "prompter": "user"}


def _role(role: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))[role], role)


def _list(field: str, role: str, text: str) -> Callable[[], Column]:
    return lambda: F.transform(F.coalesce(F.col(field), F.array()), lambda m: _turn(_role(m[role]), m[text]))


def _instruction() -> Column:
    more = F.when(F.length(F.coalesce("input", F.lit(""))) > 0, F.concat(F.lit("\n\n"), F.col("input"))).otherwise("")
    return F.array(_turn("user", F.concat(F.coalesce("instruction", F.lit("")), more)), _turn("assistant", F.col("output")))


#: Layouts by their paths (without the key): name and turns. Tables of one row a turn are grouped first.
LAYOUTS: dict[str, tuple[list[str], Callable[[], Column] | None]] = {
    "turn_rows": (["turn:number", "role:string", "text:string"], None),
    "messages": (["messages[].role:string", "messages[].content:string"], _list("messages", "role", "content")),
    "from_value": (["conversations[].from:string", "conversations[].value:string"], _list("conversations", "from", "value")),
    "prompt_response": (["prompt:string", "response:string"], lambda: F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col("response")))),
    "prompt_completion": (["prompt:string", "completion:string"], lambda: F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col("completion")))),
    "instruction": (["instruction:string", "input:string", "output:string"], _instruction),
    "question_answer": (["question:string", "answer:string"], lambda: F.array(_turn("user", F.col("question")), _turn("assistant", F.col("answer")))),
}
BY_FINGERPRINT = {fingerprint(p): name for name, (p, _) in LAYOUTS.items()}


def layout_of(df: DataFrame, key: str) -> str:
    """The layout of a table: the one of its fingerprint, or, if there are further columns, the largest that it holds.

    Of layouts with as many paths the first of LAYOUTS counts.
    """
    own = paths(T.StructType([f for f in df.schema.fields if f.name != key]))
    if (name := BY_FINGERPRINT.get(fingerprint(own))) is not None:
        return name
    inside = [name for name, (p, _) in LAYOUTS.items() if set(p) <= set(own)]
    if not inside:
        raise ValueError(f"no layout for {sorted(own)}")
    return max(inside, key=lambda name: len(LAYOUTS[name][0]))


def canonical_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """Any known layout -> key, turns: array of (role, text). Rows of turns are ordered by turn, then role and text."""
    name = layout_of(df, key)
    if (make := LAYOUTS[name][1]) is not None:
        return df.select(key, make().alias("turns"))
    rows = df.select(key, F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("x"))
    return rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def escape(text: Column) -> Column:
    """A backslash before each backslash, and inside each control string: no control string is left."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(df: DataFrame, key: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """Any known layout -> key, formatted, loss_spans: ranges of code points of formatted, one for each turn of role `learn`.

    One row for each key, a null key included; null roles and texts are empty; repeated rows stay. A spanned text is the
    turn's escaped text without its marks. Empty tables give empty tables. Other columns are ignored.
    """
    turn = canonical_turns(df, key).select(key, F.transform("turns", lambda t: F.struct((t["role"] == learn).alias("learn"), escape(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    marked = lambda t: F.when(t["learn"], F.concat(F.lit(LEARN_OPEN), t["role"], F.lit(ROLE_END), t["text"], F.lit(LEARN_CLOSE))).otherwise(F.concat(F.lit(OPEN), t["role"], F.lit(ROLE_END), t["text"], F.lit(CLOSE)))
    x = turn.select(key, "turns", F.transform("turns", marked).alias("parts"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))

    def step(a: Column, z: Column) -> Column:
        end = a["at"] + F.length(z["part"])
        head = F.length(z["turn"]["role"]) + len(LEARN_OPEN) + len(ROLE_END)
        span = F.array(F.struct((a["at"] + head).alias("begin"), (end - len(LEARN_CLOSE)).alias("end")))
        return F.struct(end.alias("at"), F.when(z["turn"]["learn"], F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    both = F.zip_with("turns", "parts", lambda t, p: F.struct(t.alias("turn"), p.alias("part")))
    return x.select(key, F.array_join("parts", "").alias("formatted"), F.aggregate(both, begin, step)["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """A formatted string -> its turns, unescaped."""
    close = r"(?<=\[/INST\])|(?<=</s>)"
    parts = F.filter(F.split(formatted, close), lambda p: F.length(p) > 0)
    inner = F.transform(parts, lambda p: F.regexp_extract(p, r"(?s)^(?:\[INST\]|<s>)(.*)(?:\[/INST\]|</s>)$", 1))
    cut = lambda p: F.instr(p, ROLE_END)
    return F.transform(inner, lambda p: F.struct(unescape(F.substring(p, F.lit(1), cut(p) - 1)).alias("role"), unescape(F.substring(p, cut(p) + len(ROLE_END), F.length(p))).alias("text")))


def read_loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["begin"] + 1, s["end"] - s["begin"]))), "")

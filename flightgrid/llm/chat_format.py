r"""Chat formatting by schema fingerprints, in DataFrame functions alone.

A layout is a set of nested field paths (``messages[].role`` and so on).  The hash of
a table's sorted paths, or of the paths of each row of a JSON column, selects the
declarative mapping that turns it into canonical turns: (conversation, order, role,
text).  Turns are then written into one text with turn marks.  Control strings in
roles and texts are made harmless by a backslash after their first character, and
backslashes are doubled first, so that dropping one backslash before any character
undoes it.  The loss mask is a list of spans, one for each assistant text.

Defined cases: null roles and texts are empty; a null order comes first; equal
orders are taken by role, then text; repeated rows are turns of their own; rows with
a null conversation make one conversation; an empty table gives an empty table; extra
columns are ignored when turns are read (of two layouts that fit, the exact one, else
the first of LAYOUTS); JSON rows of an unknown layout have null turns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, SEP, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that must not come from a text: our marks and those of usual templates.
CONTROL = (START, SEP, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(c: Column) -> Column:
    c = F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for s in CONTROL:
        c = F.replace(c, F.lit(s), F.lit(s[0] + "\\" + s[1:]))
    return c


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths; ``[]`` stands for the items of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in [f"{at}.{f.name}" if at else f.name, *paths(f.dataType, f"{at}.{f.name}" if at else f.name)]]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, at + "[]")
    return []


def fingerprint(found: list[str]) -> str:
    """The hash of a set of paths."""
    import hashlib

    return hashlib.sha256("\n".join(sorted(set(found))).encode()).hexdigest()


def _turn(role: Column | str, text: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).cast("string").alias("role"), text.cast("string").alias("text"))


#: Names of speakers in layouts of their own, as canonical roles.  Others stay.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def _role(c: Column) -> Column:
    for name, canonical in ROLES.items():
        c = F.when(F.lower(c) == name, F.lit(canonical)).otherwise(c)
    return c


def _listed(items: str, role: str, text: str) -> Callable[[Callable[[str], Column]], Column]:
    return lambda get: F.transform(get(items), lambda m: _turn(_role(m[role]), m[text]))


def _joined(get: Callable[[str], Column]) -> Column:
    more = F.coalesce(get("input"), F.lit(""))
    asked = F.when(more == "", get("instruction")).otherwise(F.concat(F.coalesce(get("instruction"), F.lit("")), F.lit("\n\n"), more))
    return F.array(_turn("user", asked), _turn("assistant", get("output")))


#: name, DDL of the fields that matter, mapping to an array of (role, text).
#: The layout with one row a turn needs no mapping.
LAYOUTS: list[tuple[str, str, Callable[[Callable[[str], Column]], Column] | None]] = [
    ("turn rows", "conv_id long, turn long, role string, text string", None),
    ("messages", "messages array<struct<role:string,content:string>>", _listed("messages", "role", "content")),
    ("from and value", "conversations array<struct<from:string,value:string>>", _listed("conversations", "from", "value")),
    ("instruction", "instruction string, input string, output string", _joined),
    ("instruction without input", "instruction string, output string", lambda get: F.array(_turn("user", get("instruction")), _turn("assistant", get("output")))),
    ("prompt and response", "prompt string, response string", lambda get: F.array(_turn("user", get("prompt")), _turn("assistant", get("response")))),
    ("prompt and completion", "prompt string, completion string", lambda get: F.array(_turn("user", get("prompt")), _turn("assistant", get("completion")))),
    ("question and answer", "question string, answer string", lambda get: F.array(_turn("user", get("question")), _turn("assistant", get("answer")))),
]


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def layout_of(schema: T.StructType) -> tuple[str, str, Callable | None]:
    """The layout with the table's fingerprint; failing that, the first whose paths
    the table has besides others."""
    own = paths(schema)
    by_print = {fingerprint(paths(_schema(ddl))): (name, ddl, m) for name, ddl, m in LAYOUTS}
    if (hit := by_print.get(fingerprint(own))) is not None:
        return hit
    for name, ddl, m in LAYOUTS:
        if set(paths(_schema(ddl))) <= set(own):
            return name, ddl, m
    raise ValueError(f"no layout has these fields: {sorted(own)}")


def canonical_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(conv_id, turn, role, text) of a table of any known layout."""
    _, _, mapping = layout_of(df.schema)
    if mapping is None:
        return df.select("conv_id", "turn", "role", "text")
    turns = df.select(F.col(key).alias("conv_id"), F.posexplode(mapping(F.col)).alias("turn", "t"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "t.role", "t.text")


def _outline(c: Column) -> Column:
    """The nested paths of a variant value: its schema without the scalar types."""
    return F.regexp_replace(F.schema_of_variant(c), r": (?!OBJECT<|ARRAY<)[A-Z]+(\([0-9,]*\))?", "")


def _outline_of(ddl: str) -> str:
    def of(kind: T.DataType) -> str:
        if isinstance(kind, T.StructType):
            return "OBJECT<" + ", ".join(f.name + (": " + s if (s := of(f.dataType)) else "") for f in sorted(kind.fields, key=lambda f: f.name)) + ">"
        return f"ARRAY<{of(kind.elementType)}>" if isinstance(kind, T.ArrayType) else ""

    return of(_schema(ddl))


def canonical_json(df: DataFrame, key: str, json: str) -> DataFrame:
    """(conv_id, layout, turns) of rows that each hold a JSON record of a layout of
    its own: the fingerprint of the row's paths selects the mapping."""
    v = F.try_parse_json(F.col(json))
    rows = df.select(F.col(key).alias("conv_id"), v.alias("v")).withColumn("print", F.sha2(_outline(F.col("v")), 256))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for name, ddl, mapping in LAYOUTS:
        if mapping is None:
            continue
        hit = F.col("print") == F.sha2(F.lit(_outline_of(ddl)), 256)
        schema = _schema(ddl)
        layout = F.when(hit, F.lit(name)).otherwise(layout)
        turns = F.when(hit, mapping(lambda f, s=schema: F.try_variant_get(F.col("v"), f"$.{f}", s[f].dataType.simpleString()))).otherwise(turns)
    return rows.select("conv_id", layout.alias("layout"), turns.alias("turns"))


def format_turns(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row a conversation: ``formatted`` and ``loss`` (array of start, from 0,
    and length in code points of each ``trained`` text as written)."""
    one = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = one.select("*", F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP)).alias("head"), escape(F.col("text")).alias("body"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    size = F.length("head") + F.length("body") + F.lit(len(END))
    one = one.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("n"),
            F.concat("head", "body", F.lit(END)).alias("piece"),
            F.when(F.col("role") == trained, F.struct((F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.length("body") - len(END)).alias("start"), F.length("body").cast("long").alias("length"))).alias("loss"),
        ).alias("t"),
    )
    held = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return held.select("conv_id", F.array_join(F.col("t.piece"), "").alias("formatted"), F.array_compact(F.col("t.loss")).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    bodies = F.filter(F.split(formatted, rf"\Q{END}\E"), lambda b: b != "")

    def turn(b: Column) -> Column:
        at = F.instr(b, SEP)
        role = b.substr(F.lit(len(START) + 1), at - len(START) - 1)
        return F.struct(unescape(role).alias("role"), unescape(b.substr(at + len(SEP), F.length(b))).alias("text"))

    return F.transform(bodies, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, end to end, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(formatted.substr((s.start + 1).cast("int"), s.length.cast("int")))), "")


def digests(turns: DataFrame) -> DataFrame:
    got = format_turns(turns).withColumns({"turns": read_turns(F.col("formatted")), "under": read_loss(F.col("formatted"), F.col("loss"))})
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2(F.col("under"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def with_control_case(conversations: DataFrame) -> DataFrame:
    """The table's turns and conversation -1, whose two texts are control strings."""
    text = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.sql(f"select * from values (-1L, 0L, 'user', '{text}'), (-1L, 1L, 'assistant', '{text}') as t(conv_id, turn, role, text)")
    return canonical_turns(conversations).unionByName(extra)


def _sql_escaped(c: str) -> str:
    out = f"replace(coalesce({c}, ''), '\\', '\\\\')"
    for s in CONTROL:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


ORACLE_SQL = f"""
with rows_ as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum({len(START + SEP + END)} + length({_sql_escaped("role")}) + length({_sql_escaped("text")})) as bigint) as formatted_chars
from rows_ group by conv_id
"""

"""Chat formatting: records of different layouts become canonical turns, then one marked text.

A record's layout is known by its fingerprint, the hash of its nested field paths. A table of
declarative mappings says how a layout's fields give turns; a layout that is in no mapping is an
error at planning (columns) or a null (JSON records).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from landmesh.llm.common import table

#: Layouts: the field paths that make one up, and the turns as pairs of role and text. A leading
#: quote marks a fixed role; turns of an array are named by the array and the fields inside.
LAYOUTS: list[tuple[tuple[str, ...], list[tuple[str, str]] | tuple[str, str, str]]] = [
    (("role", "text"), [("role", "text")]),
    (("role", "content"), [("role", "content")]),
    (("from", "value"), [("from", "value")]),
    (("prompt", "response"), [("'user", "prompt"), ("'assistant", "response")]),
    (("prompt", "completion"), [("'user", "prompt"), ("'assistant", "completion")]),
    (("question", "answer"), [("'user", "question"), ("'assistant", "answer")]),
    (("system", "prompt", "response"), [("'system", "system"), ("'user", "prompt"), ("'assistant", "response")]),
    (("instruction", "output"), [("'user", "instruction"), ("'assistant", "output")]),
    (("instruction", "input", "output"), [("'user", "instruction+input"), ("'assistant", "output")]),
    (("messages", "messages[].role", "messages[].content"), ("messages", "role", "content")),
    (("messages", "messages[].role", "messages[].text"), ("messages", "role", "text")),
    (("conversations", "conversations[].from", "conversations[].value"), ("conversations", "from", "value")),
]
#: Role names of layouts with a field `from` (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Where a backslash goes behind the first character, so that no control string is left in a
#: text: <| of this and other templates, <s>, </s>, <<SYS>>, <</SYS>>, [INST], [/INST].
_CONTROL = r"(<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\]))"


def field_paths(kind: DataType, before: str = "") -> list[str]:
    """Nested field paths of a schema; [] stands for an array's elements."""
    if isinstance(kind, ArrayType):
        return field_paths(kind.elementType, f"{before}[]")
    if isinstance(kind, StructType):
        out = []
        for f in kind.fields:
            path = f"{before}.{f.name}" if before else f.name
            out += [path, *field_paths(f.dataType, path)]
        return out
    return []


def fingerprint(paths) -> str:
    import hashlib

    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


_BY_PRINT = {fingerprint(paths): turns for paths, turns in LAYOUTS}


def _turn(role: Column, text: Column, renamed: bool = False) -> Column:
    role = F.coalesce(role.cast("string"), F.lit(""))
    for other, name in ROLES.items() if renamed else ():
        role = F.when(role == other, F.lit(name)).otherwise(role)
    return F.struct(role.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns(mapping, at) -> Column:
    """at: gives the column of a path."""
    if isinstance(mapping, tuple):
        array, role, text = mapping
        return F.coalesce(F.transform(at(array), lambda x: _turn(x[role], x[text], role == "from")), F.array().cast("array<struct<role:string,text:string>>"))

    def text_of(path: str) -> Column:
        parts = [F.nullif(at(p).cast("string"), F.lit("")) for p in path.split("+")]
        return at(path) if len(parts) == 1 else F.concat_ws("\n", *parts)

    return F.array(*(_turn(F.lit(role[1:]) if role[0] == "'" else at(role), text_of(text), role == "from") for role, text in mapping))


def canonical(records: DataFrame, payload: list[str], turns: str = "turns") -> DataFrame:
    """records with an array of turns (role, text) made from the payload columns.

    The fingerprint of the payload's field paths selects the mapping. Null texts and roles become
    empty, null arrays no turns. Other columns stay, so that they may have any names.
    """
    schema = StructType([records.schema[c] for c in payload])
    mapping = _BY_PRINT.get(fingerprint(field_paths(schema)))
    if mapping is None:
        raise ValueError(f"no mapping for the layout {field_paths(schema)}")
    return records.withColumn("__turns", _turns(mapping, F.col)).drop(*payload).withColumnRenamed("__turns", turns)


def json_paths(record: Column) -> Column:
    """The sorted field paths of a JSON record, two levels deep, as one string; computed per row."""
    keys = lambda json: F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    inner = F.flatten(
        F.transform(
            keys(record),
            lambda k: F.concat(
                F.array(k),
                F.transform(keys(F.call_function("get_json_object", record, F.concat(F.lit("$['"), k, F.lit("'][0]")))), lambda x: F.concat(k, F.lit("[]."), x)),
            ),
        )
    )
    return F.array_join(F.array_sort(inner), "\n")


def canonical_json(records: DataFrame, record: str, turns: str = "turns") -> DataFrame:
    """records with turns from a column of JSON objects of mixed layouts, told apart row by row.

    A null, broken or unknown record has null turns.
    """
    print_of = F.substring(F.sha2(json_paths(F.col(record)), 256), 1, 16)
    out = None
    for paths, mapping in LAYOUTS:
        if isinstance(mapping, tuple):
            array, role, text = mapping
            parsed = F.from_json(record, f"`{array}` array<struct<`{role}`:string,`{text}`:string>>")
        else:
            parsed = F.from_json(record, ", ".join(f"`{p}` string" for p in paths))
        made = _turns(mapping, lambda p, parsed=parsed: parsed[p])
        known = F.col("__print") == fingerprint(paths)
        out = F.when(known, made) if out is None else out.when(known, made)
    return records.withColumn("__print", print_of).withColumn("__turns", out).drop("__print", record).withColumnRenamed("__turns", turns)


def escape(text: Column) -> Column:
    """A backslash before each backslash and inside each control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One formatted text for each key from rows with role and text.

    Returns key, formatted and loss_spans (start and end, in code points of formatted, of each
    assistant text in order). Rows of equal order stand by role, then text. Null role and text
    count as empty, a null key is a key of its own. No rows, no texts.
    """
    head = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT))
    body = escape(F.coalesce("text", F.lit("")))
    rows = turns.select(*key, *order, "role", "text", head.alias("head"), body.alias("body"))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(END))
    in_order = Window.partitionBy(*key).orderBy(*order, "role", "text")
    ends = F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("at", F.row_number().over(in_order)).withColumn("end", (ends - len(END)).cast("int"))
    piece = F.struct("at", F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("role") == "assistant", F.struct((F.col("end") - F.length("body")).alias("start"), "end")).alias("span"))
    grouped = rows.groupBy(*key).agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return grouped.select(
        *key,
        F.array_join("pieces.piece", "").alias("formatted"),
        F.filter("pieces.span", lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted text."""
    one = lambda x: F.split(F.substring(x, 1, F.length(x) - len(END)), r"<\|text\|>", 2)
    marked = F.split(formatted, r"<\|turn\|>")
    return F.transform(
        F.slice(marked, 2, F.greatest(F.size(marked) - 1, F.lit(0))),
        lambda x: F.struct(unescape(one(x)[0]).alias("role"), unescape(one(x)[1]).alias("text")),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """What stands under the loss mask, unescaped, in one string."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    flat = canonical(rows, ["role", "text"])
    control = "</s>[INST] ok [/INST]"
    record = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("turn"),
        F.to_json(F.struct(F.array(*(F.struct(F.lit(r).alias("role"), F.lit(control).alias("content")) for r in ("user", "assistant"))).alias("messages"))).alias("record"),
    )
    both = flat.unionByName(canonical_json(record, "record"))
    turns = both.select("conv_id", "turn", F.posexplode("turns").alias("part", "one")).select("conv_id", "turn", "part", "one.role", "one.text")
    out = format_turns(turns, ["conv_id"], ["turn", "part"])
    back = parse(F.col("formatted"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.withColumn("turns", back).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Template marks and escapes are reversible, so that everything but the escapes is told by the input.
OP4_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, 0 AS part, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 0, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(<\||<s>|</s>|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\])', '\1+', 'g')) + length(role) + 23 AS n FROM rows_
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, part, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, part, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

"""Chat records of several layouts to one template, by a fingerprint of their nested field paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filled

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
TURNS = "array<struct<role:string,text:string>>"
#: JSON text from which a record without a value may be one that a variant (128 MiB) can't hold, not broken JSON.
LARGE = 16 << 20


def escape(text: Column) -> Column:
    """No ``<|`` is left: one backslash more in every ``<``, backslashes, ``|``. :func:`unescape` takes it out again."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


@dataclass(frozen=True)
class Mapping:
    """``sample``: a record of the layout as JSON, whose paths it is known by. ``turns``: JSON path of each turn's text
    under a fixed role, or ``("*", array path, role field, text field)`` for a list of messages."""

    name: str
    sample: str
    turns: tuple


MAPPINGS = (
    Mapping("messages", '{"messages": [{"role": "", "content": ""}]}', (("*", "$.messages", "role", "content"),)),
    Mapping("no_messages", '{"messages": []}', ()),
    Mapping("conversations", '{"conversations": [{"from": "", "value": ""}]}', (("*", "$.conversations", "from", "value"),)),
    Mapping("prompt_response", '{"prompt": "", "response": ""}', (("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping("prompt_completion", '{"prompt": "", "completion": ""}', (("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping("instruction_output", '{"instruction": "", "output": ""}', (("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping("instruction", '{"instruction": "", "input": "", "output": ""}', (("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
)


def fingerprint(record: Column) -> Column:
    """64-bit hash of the nested field paths of a variant; value types don't count."""
    paths = F.schema_of_variant(record)
    return F.xxhash64(F.regexp_replace(paths, r"(: |ARRAY<)(?!OBJECT<|ARRAY<)[A-Z_]+(\([0-9, ]*\))?", "$1_"))


def parsed(text: Column) -> Column:
    """JSON text as a variant, null where it is broken. Strings of any length; an error where the record may be too large."""
    record = F.from_json(text, "variant", {"maxStringLen": str(2**31 - 1)})  # try_parse_json gives null from 20,000,000 on
    said = F.concat(F.lit("a record of "), F.octet_length(text).cast("string"), F.lit(" bytes of JSON is broken or too large for a variant"))
    return F.when(record.isNull() & (F.octet_length(text) > LARGE), F.raise_error(said)).otherwise(record)


def outline(record: Column, kind: T.StructType) -> Column:
    """A record's JSON with every text empty: a null field is absent, and a list has one item with the fields any item has."""

    def shape(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.when(value.isNotNull(), F.struct(*(shape(value[f.name], f.dataType).alias(f.name) for f in kind)))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
            has = lambda f: F.when(F.exists(value, lambda t: t[f.name].isNotNull()), F.lit("")).alias(f.name)
            item = F.struct(*(has(f) for f in kind.elementType))
            return F.when(F.size(value) > 0, F.array(item)).when(value.isNotNull(), F.slice(F.array(item), 1, 0))
        return F.when(value.isNotNull(), F.lit(""))

    return F.to_json(shape(record, kind))


def field(path: str, kind: T.DataType, as_type: str) -> Column:
    """A path's value in ``record``: null if a struct lacks the field."""
    if not isinstance(kind, T.StructType):
        return F.variant_get("record", path, as_type)
    name = path.removeprefix("$.")
    return F.col("record")[name] if name in kind.names else F.lit(None).cast(as_type)


def messages(path: str, role: str, text: str, kind: T.DataType) -> Column:
    listed = field(path, kind, f"array<struct<`{role}`:string,`{text}`:string>>")
    name = path.removeprefix("$.")
    names = kind[name].dataType.elementType.names if isinstance(kind, T.StructType) and name in kind.names else [role, text]
    part = lambda t, f: filled(t[f]) if f in names else F.lit("")
    return F.transform(listed, lambda t: F.struct(part(t, role).alias("role"), part(t, text).alias("text")))


def read_layouts(records: DataFrame, id_col: str, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``conv_id, layout, turns``: canonical turns of records, which are JSON text or structs of texts and lists of structs.

    Broken JSON, null and unknown layouts give layout null and no turns; a missing or null field within a known layout is the
    empty text. Texts of a struct may be of any length. JSON text goes through a variant: strings may be of any length, but a
    record over its 128 MiB is an error, and so is broken JSON of over 16 MiB, which can't be told from it.
    """
    spark = records.sparkSession
    samples = " union all ".join(f"select '{m.name}' name, '{m.sample}' sample" for m in mappings)
    known = spark.sql(samples).select("name", fingerprint(F.parse_json("sample")).alias("mark"))  # one row a mapping
    read = records.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("record"))
    if not isinstance(read.schema["record"].dataType, T.StructType):
        read = read.withColumn("record", parsed(F.col("record")))
    kind = read.schema["record"].dataType
    shape = F.parse_json(outline(F.col("record"), kind)) if isinstance(kind, T.StructType) else F.col("record")
    read = read.withColumn("mark", fingerprint(shape))
    read = read.join(F.broadcast(known), "mark", "left")
    turns = F.lit(None).cast(TURNS)
    for m in mappings:
        parts = []
        for how in m.turns:
            if how[0] == "*":
                _, path, role, text = how
                parts.append(messages(path, role, text, kind))
            else:
                parts.append(F.array(F.struct(F.lit(how[0]).alias("role"), filled(field(how[1], kind, "string")).alias("text"))))
        value = F.concat(*parts) if parts else F.array().cast(TURNS)
        turns = F.when(F.col("name") == m.name, value).otherwise(turns)
    return read.select("conv_id", F.col("name").alias("layout"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def format_chats(chats: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss``, code-point spans ``(start from 1, length)`` of the assistant texts, to canonical turns.

    Each turn is a start mark, its role, a line end, its escaped text, an end mark and a line end. No turns give the empty text.
    """
    piece = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), F.replace(escape(t["role"]), F.lit("\n"), F.lit(BREAK)), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == "assistant").alias("learn"),
        ),
    )
    chats = chats.withColumn("__pieces", piece)
    tail = f"{END}\n"
    # starts are sums of the lengths before; a struct of (next start, spans) is folded over the turns
    spans = F.aggregate(
        "__pieces",
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p["head"]) + F.char_length(p["body"]) + len(tail)).alias("at"),
            F.when(
                p["learn"],
                F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.char_length(p["head"])).alias("start"), F.char_length(p["body"]).alias("length")))),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.concat_ws("", F.transform("__pieces", lambda p: F.concat(p["head"], p["body"], F.lit(tail))))
    return chats.withColumn("formatted", formatted).withColumn("loss", spans).drop("__pieces")


def read_back(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    parts = F.slice(F.split(formatted, r"\Q" + START + r"\E"), 2, 1 << 30)

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = p.substr(F.char_length(role) + 2, F.char_length(p) - F.char_length(role) - 2 - len(END))
        return F.struct(unescape(F.replace(role, F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(body).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss spans, joined."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(formatted.substr(s["start"], s["length"]))))


def as_records(rows: DataFrame) -> DataFrame:
    """``conv_id, record``: turn rows (conv_id, turn, role, text) as structs, whose fields that are not null are the layout
    that fits their roles.

    Rows are ordered by turn, then role and text; null role or text is empty. A conversation becomes one record, so its
    turns must fit one row.
    """
    turn = F.struct(F.col("turn"), filled("role").alias("role"), filled("text").alias("content"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("m"))
    roles = F.transform("m", lambda t: t["role"])
    said = lambda *names: roles == F.array(*map(F.lit, names))
    text = lambda i: F.get("m", F.lit(i))["content"]
    two, three = said("user", "assistant"), said("system", "user", "assistant")
    record = F.struct(
        F.when(~two & ~three, F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))).alias("messages"),
        F.when(two, text(0)).alias("prompt"),
        F.when(two, text(1)).alias("response"),
        F.when(three, text(0)).alias("instruction"),
        F.when(three, text(1)).alias("input"),
        F.when(three, text(2)).alias("output"),
    )
    return chats.select("conv_id", record.alias("record"))

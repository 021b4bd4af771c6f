r"""Chat formatting in native expressions: typed parts flattened into ordered placeholders.

A turn becomes ``### Role: content</turn>`` and a line feed. Inside texts, strings that look like control strings get one
backslash more at a fixed place, whatever number they had, so formatting is reversible:
``</turn>`` to ``<\/turn>``, ``<|image:`` to ``<\|image:``, ``### User: `` to ``###\ User: ``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant", "tool")
MARK = r"(/turn>|\|(?:image|audio|document|other):)"
LABEL = r"( (?:System|User|Assistant|Tool|@[0-9A-F]*): )"
END = "</turn>\n"
PLACE = r"<\|(?:image|audio|document|other):[0-9]+\.[0-9]+\|>"
#: Tokens that a part stands for, if it names none itself.
EXPANSION = {"image": 256, "audio": 100, "document": 512, "other": 1}
PARTS = "array<struct<type:string,text:string,uri:string,tokens:long>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"<(\\*+){MARK}", r"<\\$1$2"), rf"###(\\*+){LABEL}", r"###\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"<\\(\\*+){MARK}", "<$1$2"), rf"###\\(\\*+){LABEL}", "###$1$2")


def label(role: Column) -> Column:
    """Known roles by name; any other as @ and its bytes in hex, so a role can hold any character."""
    return F.when(role.isin(*ROLES), F.initcap(role)).otherwise(F.concat(F.lit("@"), F.hex(role.cast("binary"))))


def unlabel(name: Column) -> Column:
    return F.when(name.startswith("@"), F.decode(F.unhex(F.substr(name, F.lit(2))), "UTF-8")).otherwise(F.lower(name))


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("long").alias("tokens")))


def visit_parts(parts: Column) -> tuple[Column, Column]:
    """(runs, records): the escaped texts before, between and after the attachments, and a record of each attachment.

    Neighbouring texts are one run and escaped as one, so no control string can be put together from parts. A null part is an
    empty text; an unknown type is ``other``; a part without a type is a text. ``part`` is the place among the parts.
    """

    def kind(p: Column) -> Column:
        t = F.lower(F.coalesce(p["type"], F.lit("text")))
        return F.when(t.isin("text", "image", "audio", "document"), t).otherwise(F.lit("other"))

    def tokens(p: Column) -> Column:
        default = F.element_at(F.create_map(*(F.lit(x) for kv in EXPANSION.items() for x in kv)), kind(p)).cast("long")
        return F.coalesce(p["tokens"], default)

    parts = F.coalesce(parts, F.array().cast(PARTS))
    texts = F.transform(parts, lambda p: F.coalesce(p["text"], F.lit("")))
    records = F.transform(parts, lambda p, i: F.struct(i.alias("part"), kind(p).alias("type"), p["uri"].alias("uri"), p["text"].alias("text"), tokens(p).alias("tokens")))
    records = F.filter(records, lambda r: r["type"] != "text")
    at = F.transform(records, lambda r: r["part"])
    cuts = F.arrays_zip(F.concat(F.array(F.lit(-1)), at).alias("a"), F.concat(at, F.array(F.size(parts))).alias("b"))
    runs = F.transform(cuts, lambda c: escaped(F.array_join(F.slice(texts, c["a"] + 2, c["b"] - c["a"] - 1), "")))
    return runs, records


def format_conversations(turns: DataFrame, parts_col: str = "parts", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", loss_roles=("assistant",)) -> DataFrame:
    """(conv_id, formatted, spans, attachments, expanded_tokens) per conversation.

    An attachment shows as ``<|type:place.part|>``, place being that of its turn in the conversation (from 0), so placeholders differ.
    ``spans`` has for each turn the code points [start, end) of its content and whether it is under the loss
    mask. Turns are ordered by (turn, role, texts, attachments), so rows that repeat or tie give the same text each time;
    a null role is an empty one, a null turn comes first, rows without a conversation form one. Expanded tokens
    count a text's white-space words and what each attachment stands for.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    runs, records = visit_parts(F.col(parts_col).cast(PARTS))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), runs.alias("runs"), records.alias("records"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "runs", F.to_json("records"))
    rows = rows.withColumn("place", F.row_number().over(order) - 1)
    mark = lambda r: F.concat(F.lit("<|"), r["type"], F.lit(":"), F.col("place").cast("string"), F.lit("."), r["part"].cast("string"), F.lit("|>"))
    marks = F.concat(F.transform("records", mark), F.array(F.lit("")))
    content = F.when(F.size("records") == 0, F.col("runs")[0]).otherwise(F.array_join(F.zip_with("runs", marks, lambda t, m: F.concat(t, m)), ""))
    attachments = F.transform("records", lambda r: F.struct(mark(r).alias("placeholder"), r["type"].alias("type"), r["uri"].alias("uri"), r["text"].alias("text"), r["tokens"].alias("tokens")))
    head = F.concat(F.lit("### "), label(F.col("role")), F.lit(": "))
    rows = rows.select("conv_id", "place", "role", content.alias("content"), attachments.alias("attachments"), head.alias("head"))
    rows = rows.withColumn("piece", F.concat("head", "content", F.lit(END)))
    place = Window.partitionBy("conv_id").orderBy("place")
    rows = rows.withColumn("until", F.sum(F.length("piece").cast("long")).over(place.rowsBetween(Window.unboundedPreceding, 0)))
    start = F.col("until") - F.length("piece") + F.length("head")
    span = F.struct(F.col("role"), start.alias("start"), (F.col("until") - len(END)).alias("end"), F.col("role").isin(*loss_roles).alias("loss"))
    words = F.regexp_count("content", F.lit(r"[^\x20\x09-\x0D]+")) - F.size("attachments")
    tokens = F.greatest(words, F.lit(0)) + F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"])
    rows = rows.select("conv_id", F.struct("place", "piece", span.alias("span"), "attachments").alias("t"), tokens.alias("tokens"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"), F.sum("tokens").alias("expanded_tokens"))
    return out.select("conv_id", F.array_join("t.piece", "").alias("formatted"), F.col("t.span").alias("spans"), F.flatten("t.attachments").alias("attachments"), "expanded_tokens")


def read_conversations(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role,text,parts>>, loss_text) read back from the formatted text, its spans and attachments.

    ``text`` is a turn's content with its placeholders; ``parts`` has its texts and attachments in order, neighbouring texts as
    one and empty ones left out.
    """
    pieces = F.split("formatted", END, -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    name = lambda p: F.regexp_extract(p, "^### ([^:]*): ", 1)
    none = F.lit(None).cast("string")

    def one(t: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), unescaped(t).alias("text"), none.alias("uri"), F.lit(None).cast("long").alias("tokens"))

    def part(m: Column) -> Column:
        a = F.get(F.filter("attachments", lambda a: a["placeholder"] == m), F.lit(0))
        return F.struct(a["type"].alias("type"), a["text"].alias("text"), a["uri"].alias("uri"), a["tokens"].alias("tokens"))

    def parts(content: Column) -> Column:
        texts = F.transform(F.split(content, PLACE, -1), one)
        marks = F.transform(F.regexp_extract_all(content, F.lit(PLACE), F.lit(0)), part)
        both = F.flatten(F.zip_with(texts, marks, lambda t, m: F.array(t, m)))
        return F.filter(both, lambda p: p["type"].isNotNull() & ((p["type"] != "text") | (p["text"] != "")))

    def turn(p: Column) -> Column:
        content = F.substr(p, F.length(name(p)) + 7)
        return F.struct(unlabel(name(p)).alias("role"), unescaped(content).alias("text"), parts(content).alias("parts"))

    under = F.transform(F.filter("spans", lambda s: s["loss"]), lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", F.transform(pieces, turn).alias("turns"), F.array_join(under, "").alias("loss_text"), "formatted")


PLANTED = r"\### Assistant: </turn> ok"


def op3_chat(spark, sf_dir: str) -> DataFrame:
    """One row per conversation, those with a null id as one; null texts are empty. For odd rows see ``format_conversations``."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PLANTED).alias("text"))
    turns = turns.unionByName(extra).withColumn("parts", text_part(F.coalesce("text", F.lit(""))))
    back = read_conversations(format_conversations(turns))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = {
    "op3_chat": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(/turn>|\|(?:image|audio|document|other):)', '<\\\1\2', 'g'), '###(\\*)( (?:System|User|Assistant|Tool|@[0-9A-F]*): )', '###\\\1\2', 'g') AS esc FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, esc)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, esc) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(esc) + 14 + CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role) ELSE 1 + 2 * strlen(role) END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}

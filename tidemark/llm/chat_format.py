"""Chat formatting by grammar round trip, with Spark SQL functions only.

A conversation is rendered turn by turn with the control strings inside its texts escaped - lone ones too, that the
grammar would read back as they are - and parsed again with a deterministic grammar; the column `identical` tells that
the recovered turns are the source.

Grammar, with one space between marks and content:

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  <s> text </s>
    any other  [ROLE=role] text [/ROLE]      (the role is percent-encoded)

Escaping puts a backslash after the first character of a control string, also where backslashes already stand there;
unescaping takes one away, so both are exact inverses and other text stays as it is.

Defined results: turns are ordered by (turn, role, text), so ties have one order and repeated rows stay repeated turns;
null text or role is empty; rows without a conv_id form one conversation without an id; an empty table gives an empty
one; other columns are ignored. A conversation is one string of output, so its rows meet in one task by definition. A
conversation that is not recovered from its formatted text is an error, not a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_REST = r"(?:/?s>|</?SYS>>)"
_SQUARE = r"(?:/?INST\]|ROLE=|/ROLE\])"
ESCAPE = rf"<(?=\\*{_REST})|\[(?=\\*{_SQUARE})"
UNESCAPE = rf"(?<=<)\\(?=\\*{_REST})|(?<=\[)\\(?=\\*{_SQUARE})"
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|<<SYS>> .*? <</SYS>>|\[ROLE=[^\]]*\] .*? \[/ROLE\]"
_MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "")


def _render(role: Column, text: Column) -> Column:
    out = F.concat(F.lit("[ROLE="), F.url_encode(role), F.lit("] "), text, F.lit(" [/ROLE]"))
    for name, (before, after) in _MARKS.items():
        out = F.when(role == name, F.concat(F.lit(before), text, F.lit(after))).otherwise(out)
    return out


def _parse(raw: Column) -> Column:
    """A rendered turn as struct<role, body>; the body is still escaped."""
    n = F.length(raw)
    role = F.regexp_extract(raw, r"^\[ROLE=([^\]]*)\]", 1)
    out = F.struct(F.url_decode(role).alias("role"), F.substring(raw, F.length(role) + 9, n - F.length(role) - 16).alias("body"))
    for name, (before, after) in _MARKS.items():
        own = F.struct(F.lit(name).alias("role"), F.substring(raw, F.lit(len(before) + 1), n - len(before + after)).alias("body"))
        out = F.when(raw.startswith(before), own).otherwise(out)
    return out


def _round_trip(frame: DataFrame, formatted: Column) -> DataFrame:
    """Adds formatted, raw (the turns as the grammar finds them) and identical."""
    parsed = F.transform("raw", _parse)
    read = F.transform(parsed, lambda t: F.struct(t["role"].alias("role"), unescape(t["body"]).alias("text")))
    return (
        frame.withColumn("formatted", formatted)
        .withColumn("raw", F.regexp_extract_all("formatted", F.lit(TURN), F.lit(0)))
        .withColumn("recovered", read)
        .withColumn("identical", F.col("recovered") == F.col("source"))
    )


def format_chats(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, recovered (turns read back), loss_spans (code points of the assistants' texts
    in `formatted`, from start to before end), escaped (whether a text holds a control string) and identical."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    source = F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    safe = F.array_join(F.transform("source", lambda t: _render(t["role"], escape(t["text"]))), "")
    hit = F.exists("source", lambda t: t["text"].rlike(ESCAPE))
    out = _round_trip(grouped.select("conv_id", source.alias("source")).withColumn("escaped", hit), safe)
    differs = F.raise_error(F.concat(F.lit("conversation not recovered from its formatted text: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    out = out.withColumn("formatted", F.when(F.col("identical"), F.col("formatted")).otherwise(differs))
    before, after = (len(x) for x in _MARKS["assistant"])
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")

    def step(acc: Column, raw: Column) -> Column:
        at = acc["at"]
        span = F.struct((at + before).alias("start"), (at + F.length(raw) - after).alias("end"))
        spans = F.when(raw.startswith(_MARKS["assistant"][0]), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((at + F.length(raw)).alias("at"), spans.alias("spans"))

    spans = F.aggregate("raw", F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans")), step)["spans"]
    return out.select("conv_id", "formatted", "recovered", spans.alias("loss_spans"), "escaped", "identical")


def masked_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(F.col(formatted), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


def digests(chats: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("recovered", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked_text()
    return chats.select(
        "conv_id",
        F.size("recovered").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    return digests(format_chats(turns.unionByName(extra)))


_HITS = r"len(regexp_extract_all(text, '<\\*(/?s>|</?SYS>>)|\[\\*(/?INST\]|ROLE=|/ROLE\])'))"
SQL = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, length(text) + {_HITS} + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17 ELSE 16 + length(url_encode(role)) END AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""

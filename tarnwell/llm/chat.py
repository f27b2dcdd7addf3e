r"""Chat formatting as a relational query, in DataFrame functions only.

The rows of a conversation are collected as structs and sorted; adjacent turns of one role become one block

    <|im_start|>role\n text <|seg|> text <|im_end|>\n

whose segments are the rows' texts. A control string inside a text, of this template or of the common bracket and
sentence-mark templates, gets one more backslash behind its first character, so no text can open, close or part a
block, and taking one backslash away again gives the text back. In a role, backslashes and newlines are escaped too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE, PART = "<|im_start|>", "<|im_end|>\n", "<|seg|>"
#: How control strings of chat templates begin, and what follows.
CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"
#: The conversation that the query adds: texts that look like a template's own marks.
FIXTURE_ID, FIXTURE_TEXT = -7, "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    plain = unescape(role)
    return F.regexp_replace(F.regexp_replace(plain, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\\\", "\\\\")


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: tuple = ("assistant",)) -> DataFrame:
    """One row per conversation: conv, formatted, and segments, an array of (text, loss) whose texts joined are
    formatted; loss marks the texts of the roles to learn.

    Rows are sorted by turn, then role, then text; nulls come first. A null text or role is empty. Rows without a
    conversation id are one conversation. Rows that repeat all stay. Other columns are ignored, whatever their names.
    """
    r = rows.select(F.col(conv).alias("c"), F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")).alias("m"))
    chats = r.groupBy("c").agg(F.sort_array(F.collect_list("m")).alias("m"))
    n = F.size("m")
    firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (F.get("m", i)["r"] != F.get("m", i - 1)["r"]))
    chats = chats.withColumn("first", firsts)
    block = lambda i, k: F.slice("m", i + 1, F.coalesce(F.get("first", k + 1), n) - i)
    chats = chats.withColumn("blocks", F.transform("first", block))
    plain = lambda s: F.struct(s.alias("text"), F.lit(False).alias("loss"))

    def marked(b: Column) -> Column:
        head = plain(F.concat(F.lit(OPEN), _escape_role(b[0]["r"]), F.lit("\n")))
        body = F.transform(b, lambda m, j: F.array(plain(F.when(j > 0, F.lit(PART)).otherwise(F.lit(""))), F.struct(escape(m["x"]).alias("text"), m["r"].isin(*learn).alias("loss"))))
        return F.concat(F.array(head), F.flatten(body), F.array(plain(F.lit(CLOSE))))

    segments = F.filter(F.flatten(F.transform("blocks", marked)), lambda s: s["text"] != "")
    out = chats.select(F.col("c").alias(conv), segments.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), "")).select(conv, "formatted", "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        inner = F.substr(b, F.lit(len(OPEN) + 1))
        end = F.instr(inner, "\n")
        name = _unescape_role(F.substr(inner, F.lit(1), end - 1))
        return F.transform(F.split(F.substr(inner, end + 1), r"<\|seg\|>"), lambda x: F.struct(name.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(1).select(F.explode(F.array(*(F.struct(F.lit(t).cast("long").alias("turn"), F.lit(r).alias("role")) for t, r in enumerate(("user", "assistant"))))).alias("m"))
    added = added.select(F.lit(FIXTURE_ID).cast("long").alias("conv_id"), "m.turn", "m.role", F.lit(FIXTURE_TEXT).alias("text"))
    made = format_chats(chats.unionByName(added)).withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return made.withColumn("learnt", learnt).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS first,
         length(regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')) AS chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars + CASE WHEN first THEN 12 + length(role) + 1 + 11 ELSE 7 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

Column expressions only. A turn is written ``<|start|>role<|body|>text<|end|>``. Control strings inside roles and
texts are escaped with %, so that the written form can always be read back.

Defined cases: a null role or text counts as empty; turns of a conversation that have the same number are ordered by
role, then text; repeated rows are turns of their own; rows with a null conv_id form one conversation; an empty table
gives no rows; other columns are ignored. An example holds all turns before its reply, so a conversation's output
grows with the square of its number of turns: that is what the method asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bookloom.llm.common import let

START, BODY, END = "<|start|>", "<|body|>", "<|end|>"
#: Control strings and how they are written inside a text; % itself comes first.
ESCAPES = [
    ("%", "%25"),
    ("<|", "%3C|"),
    ("<s>", "%3Cs>"),
    ("</s>", "%3C/s>"),
    ("<<SYS>>", "%3C<SYS>>"),
    ("<</SYS>>", "%3C</SYS>>"),
    ("[INST]", "%5BINST]"),
    ("[/INST]", "%5B/INST]"),
]
UNESCAPES = [("%3C", "<"), ("%5B", "["), ("%25", "%")]


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in UNESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, head, body>> in order; head and body as they are written."""
    empty = F.lit("")
    rows = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return turns.select(
        "conv_id",
        F.transform(
            "turns",
            lambda t: F.struct(
                t["role"].alias("role"),
                F.concat(F.lit(START), escape(t["role"]), F.lit(BODY)).alias("head"),
                escape(t["text"]).alias("body"),
            ),
        ).alias("turns"),
    )


def prefix_target_examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, example (0, 1, ...), n_turns, text, loss_start, loss_end.

    text holds all turns up to the reply; only the code points from loss_start to loss_end are trainable. Turns after
    the last reply (or a conversation without one) give one last example that trains nothing: loss_start = loss_end.
    """
    turns = format_turns(conversations)
    last = F.size("turns") - 1
    picked = F.filter(
        F.sequence(F.lit(0), last),
        lambda i: (F.get(F.col("turns"), i)["role"] == "assistant") | (i == last),
    )
    rows = turns.select("conv_id", "turns", F.posexplode(picked).alias("example", "i"))
    turn = F.get(F.col("turns"), F.col("i"))
    write = lambda xs: F.array_join(F.transform(xs, lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    rows = rows.select(
        "conv_id",
        "example",
        (F.col("i") + 1).alias("n_turns"),
        write(F.slice("turns", 1, F.col("i"))).alias("before"),
        turn["head"].alias("head"),
        turn["body"].alias("body"),
        (turn["role"] == "assistant").alias("trained"),
    )
    start = F.char_length("before") + F.char_length("head")
    return rows.select(
        "conv_id",
        "example",
        "n_turns",
        F.concat("before", "head", "body", F.lit(END)).alias("text"),
        start.cast("long").alias("loss_start"),
        (start + F.when(F.col("trained"), F.char_length("body")).otherwise(0)).cast("long").alias("loss_end"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>>, losses array<string>, formatted: parsed out of the written examples."""
    per = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("formatted"),
        F.sort_array(
            F.collect_list(F.struct("example", F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")).alias("loss")))
        ).alias("losses"),
    )
    parts = F.split("formatted", r"<\|end\|>")
    turn = lambda p: F.struct(
        unescape(F.substring(F.substring_index(p, BODY, 1), len(START) + 1, 1 << 30)).alias("role"),
        unescape(let(F.instr(p, BODY), lambda at: F.substring(p, at + len(BODY), F.lit(1 << 30)))).alias("text"),
    )
    return per.select(
        "conv_id",
        "formatted",
        F.transform(F.slice(parts, 1, F.size(parts) - 1), turn).alias("turns"),
        F.transform("losses", lambda x: unescape(x["loss"])).alias("losses"),
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    planted = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L conv_id, turn, role, '{planted}' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    back = read_back(prefix_target_examples(table.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def _escaped_sql(c: str) -> str:
    for a, b in ESCAPES:
        c = f"replace({c}, '{a}', '{b}')"
    return c


OP8_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length({_escaped_sql("role")}) + length({_escaped_sql("text")}) + {len(START + BODY + END)})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

"""Chat formatting: messages rebuilt from an event log, rendered with reversible escapes and a loss mask (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed marks of the template: a turn is HEAD role MID text TAIL.
HEAD, MID, TAIL = "### ", ": ", "</turn>\n"
#: The role whose texts are trained on.
LOSS_ROLE = "assistant"


def escape(c: Column) -> Column:
    """c without any mark of the template: a backslash stands before what it takes out of its role."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("#"), F.lit("\\#"))
    return F.replace(c, F.lit("</turn>"), F.lit("<\\/turn>"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """Fold an event log into its final messages: (conv_id, msg, role, text).

    events: conv_id, seq, kind, role, text, target.  Within a conversation events apply by seq (ties: by role, then
    text; null first).  Kinds: `message` begins a message; `delta` adds text to a message; `edit` replaces its text;
    `regenerate` discards it and starts it anew with the event's text.  The last three apply to the message numbered
    `target` (from 1), or where that is null to the latest begun; those that refer to no message are ignored, as are
    unknown kinds.  A null text is empty, a null role too; repeated rows are events of their own.

    The fold has a closed form: a message is its last message, edit or regenerate event followed by later deltas.
    So only the running count of begun messages needs a conversation's order; the texts meet per message.
    """
    order = Window.partitionBy("conv_id").orderBy("seq", "role", "text")
    begun = F.sum(F.when(F.col("kind") == "message", 1).otherwise(0))
    e = events.select("conv_id", "seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"), "target")
    e = e.where(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    e = e.withColumns({"at": F.row_number().over(order), "msg": begun.over(order.rowsBetween(Window.unboundedPreceding, 0))})
    e = e.withColumn("latest", F.col("msg"))
    e = e.withColumn("msg", F.when(F.col("kind") != "message", F.coalesce("target", "msg")).otherwise(F.col("msg")))
    e = e.where(F.col("msg").between(1, F.col("latest")))
    one = Window.partitionBy("conv_id", "msg")
    e = e.withColumn("base", F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(one))
    pieces = F.array_sort(F.collect_list(F.when(F.col("at") >= F.col("base"), F.struct("at", "text"))))
    return e.groupBy("conv_id", "msg").agg(
        F.coalesce(F.max(F.when(F.col("kind") == "message", F.col("role"))), F.lit("")).alias("role"),
        F.array_join(F.transform(pieces, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): the conversation as one text, and its loss mask as spans (first character from 1, length).

    A conversation is one training text, so its turns meet in one row; nothing else is gathered.
    """
    role = F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\:"))
    m = messages.withColumns({"head": F.concat(F.lit(HEAD), role, F.lit(MID)), "body": escape(F.col("text"))})
    m = m.withColumn("turn", F.concat("head", "body", F.lit(TAIL)))
    before = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("turn").cast("long")).over(before), F.lit(0)) + F.char_length("head") + 1
    m = m.withColumn("span", F.when(F.col("role") == LOSS_ROLE, F.struct(start.alias("first"), F.char_length("body").cast("long").alias("length"))))
    turns = F.array_sort(F.collect_list(F.struct("msg", "turn")))
    return m.groupBy("conv_id").agg(
        F.array_join(F.transform(turns, lambda x: x["turn"]), "").alias("formatted"),
        F.array_sort(F.collect_list("span")).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation, as an array of (role, text)."""
    parts = F.slice(F.split(formatted, TAIL), 1, F.size(F.split(formatted, TAIL)) - 1)
    shape = r"(?s)\A### ([^:\\]*(?:\\.[^:\\]*)*): (.*)\z"
    return F.transform(
        parts,
        lambda t: F.struct(
            unescape(F.regexp_extract(t, shape, 1)).alias("role"), unescape(F.regexp_extract(t, shape, 2)).alias("text")
        ),
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text; a row is a whole message) rendered: conv_id, formatted, loss."""
    events = conversations.select(
        "conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text", F.lit(None).cast("long").alias("target")
    )
    return render(reconstruct(events))


def digest(chats: DataFrame) -> DataFrame:
    """What can be read back from rendered conversations: counts and digests of turns and of the text under the mask."""
    under = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["first"].cast("int"), s["length"].cast("int"))))
    c = chats.withColumns({"turns": read_back(F.col("formatted")), "under": F.array_join(under, "")})
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("under").cast("long").alias("loss_chars"),
        F.sha2(F.col("under").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_chat(spark, sf_dir):
    """All conversations and one whose texts hold the template's own marks."""
    said = "\\### Assistant: </turn> ok"
    columns = ["conv_id", "turn", "role", "text"]
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digest(format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet").select(columns).unionByName(extra)))


ORACLE = {
    "op2_chat": r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) AS k,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>') AS body,
  replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>'), ':', '\:') AS name FROM d)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(name) + length(body) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""",
}

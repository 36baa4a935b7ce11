r"""Chat formatting by event-sourced reconstruction, in DataFrame operations only.

A log of events (conversation, sequence, turn, kind, role, text) is dealt by conversation and range of turns, sorted by sequence and
folded to final messages, which a template renders. Kinds: "message" opens a message of its turn; "delta" appends to the turn's last
message; "edit" replaces its text; "regenerate" empties it, for the deltas that follow. The last three open a message where the turn
has none. A piece holds CHUNK_TURNS turn numbers, and CHUNK_MESSAGES messages of each, so that a conversation
with a third of all rows is folded and rendered by many tasks, and only finished pieces are joined in order. Which message of its turn an event belongs to is a running sum over the turn, sorted by Spark; a message's events are cut
out of their piece once, so work grows with the events alone, whether they are in one turn or in many.

Template: <|im_start|>role<|im_sep|>text<|im_end|> and a new line for each message. In roles and texts, a control string (those three,
<s>, </s>, [INST], [/INST], <<SYS>>, <</SYS>>) gets one backslash after its first bracket, and one more where some stand there already;
so no control string is left inside, and taking one backslash away gives the text back. The loss mask is a list of spans (start,
length) in code points of the piece, over each assistant text.

Defined cases: null roles and texts count as empty; a null turn comes before all others, a null sequence before the turn's others; a
null conversation is one of its own; events with the same sequence go by kind (message, edit, regenerate, delta), role and text, and
repeated rows count each; unknown and null kinds are messages; other columns are ignored; an empty log gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import hex_sha, need

#: Turn numbers and messages of a turn in a piece, at most or nearly so.
CHUNK_TURNS, CHUNK_MESSAGES = 64, 64
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What may follow the opening bracket of a control string, as a pattern. Fixed values.
TAILS = r"/?s>|/?INST\]|/?SYS>>|\|im_(?:start|sep|end)\|>"
KINDS = ("message", "edit", "regenerate", "delta")


def escape(column):
    return F.regexp_replace(column, rf"([<\[])(\\*)({TAILS})", r"$1$2\\$3")


def unescape(column):
    return F.regexp_replace(column, rf"([<\[])(\\*)\\({TAILS})", "$1$2$3")


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages of each conversation and piece: conv_id, chunk (of turns), part (of messages), messages."""
    need(events, "conv_id", "seq", "turn", "kind", "role", "text")
    number = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = events.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("seq").cast("long").alias("seq"), F.greatest(number - 1, F.lit(0)).cast("int").alias("kind"), blank("role"), blank("text"))
    # A turn's first event, and every message, opens one: its number is a running sum, which Spark sorts for and holds nothing of.
    in_turn = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text")
    opens = ((F.col("kind") == 0) | (F.row_number().over(in_turn) == 1)).cast("long")
    rows = rows.withColumn("opens", opens).withColumn("message", F.sum("opens").over(in_turn.rowsBetween(Window.unboundedPreceding, 0)))
    # Of a message's events count the last that sets its text, and the deltas after it.
    event = F.struct("turn", "message", "seq", "kind", "role", "text", "opens")
    pieces = rows.groupBy("conv_id", F.floor(F.col("turn") / CHUNK_TURNS).alias("chunk"), F.floor(F.col("message") / CHUNK_MESSAGES).alias("part")).agg(F.sort_array(F.collect_list(event)).alias("events"))
    at = lambda i: F.get("events", i)
    pieces = pieces.withColumn("begins", F.filter(F.sequence(F.lit(0), F.size("events") - 1), lambda i: at(i)["opens"] == 1))
    pieces = pieces.withColumn("own", F.transform("begins", lambda b, j: F.slice("events", b + 1, F.coalesce(F.get("begins", j + 1), F.size("events")) - b)))
    sets = F.transform("own", lambda m: F.struct(m.alias("m"), F.array_max(F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | F.get(m, i)["kind"].isin(1, 2))).alias("last")))
    pieces = pieces.withColumn("own", sets)
    text = lambda x: F.array_join(F.transform(F.slice(x["m"], x["last"] + 1, F.size(x["m"])), lambda e: F.when(e["kind"] == 2, "").otherwise(e["text"])), "")
    messages = F.transform("own", lambda x: F.struct(F.get(x["m"], F.lit(0))["turn"].alias("turn"), F.get(x["m"], F.lit(0))["role"].alias("role"), text(x).alias("text")))
    return pieces.select("conv_id", "chunk", "part", messages.alias("messages"))


def render(messages: DataFrame) -> DataFrame:
    """Formatted pieces with their loss mask: conv_id, chunk, n_turns, formatted, loss_spans."""
    pieces = F.transform(
        "messages",
        lambda m: F.struct(
            F.concat(F.lit(START), escape(m["role"]), F.lit(SEP)).alias("head"),
            escape(m["text"]).alias("body"),
            (m["role"] == "assistant").alias("loss"),
        ),
    )
    tail = END + "\n"
    # A piece holds some thousand messages at most, so sums over those before each are bounded.
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.lit([]).cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["body"]) + len(tail)).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(tail))), "")
    return messages.select("conv_id", "chunk", "part", F.size("messages").alias("n_turns"), pieces.alias("parts")).select("conv_id", "chunk", "part", "n_turns", formatted.alias("formatted"), spans.alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    """Reconstruct and render: a row for each conversation and piece; a conversation's text is its pieces in the order of chunk and part."""
    return render(reconstruct(events))


def read_back(pieces: DataFrame) -> DataFrame:
    """What the formatted pieces say: conv_id, chunk, part, turns (role, text) and loss_text, from the text and the mask alone."""
    blocks = F.filter(F.split("formatted", rf"\Q{END}\E\n", -1), lambda b: b != "")
    cuts = F.transform(blocks, lambda b: F.split(F.substring(b, len(START) + 1, 1 << 30), rf"\Q{SEP}\E", -1))
    turns = F.transform(cuts, lambda c: F.struct(unescape(F.element_at(c, 1)).alias("role"), unescape(F.element_at(c, 2)).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return pieces.select("conv_id", "chunk", "part", turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def message_log(conversations: DataFrame) -> DataFrame:
    """A table of whole messages as a log: each row is a message event whose sequence is its turn."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")


def query(conversations: DataFrame) -> DataFrame:
    """Result of op4, with conversation -1 added: a row for each conversation."""
    hard = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    log = message_log(conversations.select("conv_id", "turn", "role", "text").unionByName(extra))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    pieces = read_back(format_chats(log)).select("conv_id", "chunk", "part", F.size("turns").alias("n"), said.alias("said"), "loss_text", "formatted_chars")
    whole = pieces.groupBy("conv_id").agg(F.sum("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list(F.struct("chunk", "part", "said", "loss_text"))).alias("p"), F.sum("formatted_chars").alias("formatted_chars"))
    text = lambda name: F.array_join(F.transform("p", lambda x: x[name]), "")
    return whole.select("conv_id", "n_turns", hex_sha(text("said")).alias("turns_sha256"), F.length(text("loss_text")).cast("long").alias("loss_chars"), hex_sha(text("loss_text")).alias("loss_sha256"), "formatted_chars")


ESCAPED = r"regexp_replace({}, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>>|\|im_(?:start|sep|end)\|>)', '\1\2\\\3', 'g')"
ORACLE = rf"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length('{START}{SEP}{END}') + 1 + length({ESCAPED.format("role")}) + length({ESCAPED.format("text")})) AS formatted_chars
  FROM m GROUP BY conv_id)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM c
"""

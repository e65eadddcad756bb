"""Conversations rebuilt from a log of events and rendered with a template, in DataFrame functions only.

A log row is (conv_id, seq, part, kind, message, role, text); seq orders a conversation's events and part what
came in one of them. Kinds:

* ``message`` opens a message with a role and the beginning of its text;
* ``delta`` appends to the message;
* ``edit`` replaces its text, ``regenerate`` empties it for new deltas; both supersede every message
  that was opened after it and before the event, because those answered what is no longer said.

Log rows are partitioned by message, so that a long conversation is several tasks' work. Summaries of messages
(four numbers each, summed up before they are shuffled) tell which messages and which of their events count;
only those are gathered, folded in order into texts, and these into one rendered row a conversation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkwell.llm.common import cut, whole_text

# The template: a turn is TURN role SAY text END.
TURN, SAY, END = "<|turn|>", "<|say|>", "<|end|>\n"
END_PATTERN, SAY_PATTERN = r"<\|end\|>\n", r"<\|say\|>"
LEARNT = "assistant"
# Strings that chat formats use for control, without their first character; <| begins all those of its kind.
CONTROL = ("|", "s>", "/s>", "INST]", "/INST]", "<SYS>>", "</SYS>>", "start_of_turn>", "end_of_turn>", "bos>", "eos>", "pad>")
_REST = "|".join(c.replace("|", r"\|").replace("]", r"\]") for c in CONTROL)
#: An opening character, backslashes, and what would make it a control string; escaping adds a backslash between them.
PLAIN, ESCAPED = rf"([<\[])(\\*)({_REST})", rf"([<\[])\\(\\*)({_REST})"


def escape(text: Column) -> Column:
    """Text in which no control string is left: a backslash goes in after the first character of each, one more where there are some."""
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    """What escape() was given."""
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


RESETS, CUTS = ("message", "edit", "regenerate"), ("edit", "regenerate")


def fold(log: DataFrame) -> DataFrame:
    """Messages that are left at the end of the log: conv_id, opened (struct of seq and part), message, role, text.

    Null texts are empty, null roles too; null conv_ids form one conversation, null message ids one message in each;
    null seqs and parts come first. Messages that nothing opened are left out with their events. Events that are
    equal in (seq, part) are taken by kind, then text; two messages opened at one (seq, part) count as opened
    one after the other by role, then id. A second opening of a message replaces role and text and keeps the place.
    An empty log gives no messages; further columns are left out.
    """
    at = F.struct("seq", "part")
    events = log.select("conv_id", at.alias("at"), "kind", "message", F.coalesce("role", F.lit("")).alias("role"), whole_text().alias("text"))
    when = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("at"))
    opening = F.struct("at", "role", "text")
    heads = events.groupBy("conv_id", "message").agg(
        F.min(when("message")).alias("opened"), F.max(when(*RESETS)).alias("reset"), F.max(when(*CUTS)).alias("cut"), F.max(F.when(F.col("kind") == "message", opening))["role"].alias("role")
    )
    # An event at the same place as an opening counts as after it.
    before = Window.partitionBy("conv_id").orderBy("opened", "role", "message").rowsBetween(Window.unboundedPreceding, -1)
    left = heads.where("opened is not null").withColumn("last_cut", F.max("cut").over(before)).where("last_cut is null or last_cut < opened")
    on = [F.col(f"e.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("conv_id", "message")]
    pieces = events.alias("e").join(left.alias("h"), reduce(lambda a, b: a & b, on)).where("e.at >= h.reset")
    rank = F.when(F.col("e.kind") == "delta", 1).otherwise(0)
    said = F.when(F.col("e.kind") == "regenerate", "").otherwise(F.col("e.text"))
    told = pieces.groupBy("e.conv_id", "e.message").agg(F.first("h.opened").alias("opened"), F.first("h.role").alias("role"), F.sort_array(F.collect_list(F.struct("e.at", rank.alias("rank"), said.alias("text")))).alias("told"))
    return told.select("conv_id", "opened", "message", "role", F.array_join(F.col("told.text"), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns and parts of every conversation of messages (conv_id, opened, message, role, text).

    parts is an array of (text, loss), in order: what stands before a text, the text, what stands behind it. loss is
    true for the texts of the assistant; all parts' texts, one after another, are the formatted conversation.
    """
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    turn = F.array(part(F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAY)), no), part(escape(F.col("text")), F.col("role") == LEARNT), part(F.lit(END), no))
    turns = messages.select("conv_id", F.struct("opened", "role", "text", "message", turn.alias("turn")).alias("turn"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.flatten(F.col("turns.turn")).alias("parts"))


def formatted(parts: Column) -> Column:
    """The text of a rendered conversation."""
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def read_back(text: Column) -> Column:
    """The turns (role, text) of a formatted text, unescaped."""
    pieces = F.filter(F.split(text, END_PATTERN), lambda piece: piece.startswith(TURN))
    cells = F.transform(pieces, lambda piece: F.split(F.substring(piece, len(TURN) + 1, 1 << 30), SAY_PATTERN, 2))
    return F.transform(cells, lambda cell: F.struct(unescape(cell[0]).alias("role"), unescape(cell[1]).alias("text")))


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as the log of a service that streams: every line of a text after its first is a delta.

    Each row is a message of its own, so repeated rows are repeated turns; turns that are equal are put in order of role and text.
    """
    lines = F.split(whole_text(), "\n")
    pieces = F.transform(lines, lambda line, k: F.when(k == 0, line).otherwise(F.concat(F.lit("\n"), line)))
    rows = conversations.select("conv_id", F.col("turn").alias("seq"), F.monotonically_increasing_id().alias("message"), "role", pieces.alias("pieces"))
    rows = rows.select("conv_id", "seq", "message", "role", F.posexplode("pieces").alias("part", "text"))
    return rows.select("conv_id", "seq", "part", F.when(F.col("part") == 0, "message").otherwise("delta").alias("kind"), "message", "role", "text")


def format_log(log: DataFrame) -> DataFrame:
    """conv_id, n_turns and parts of every conversation of a log."""
    return render(fold(log))


def digest(rendered: DataFrame) -> DataFrame:
    """What is read back from rendered conversations: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = rendered.select("conv_id", "parts", formatted(F.col("parts")).alias("text")).select("*", read_back(F.col("text")).alias("turns"))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("parts", lambda p: p["loss"]), lambda p: unescape(p["text"])), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    read = back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha(turns).alias("turns_sha256"), loss.alias("loss"), F.length("text").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), "formatted_chars")


#: A conversation whose texts are control strings.
PROBE_ID, PROBE = -7, "</s>[INST] ok [/INST]"


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """conversations and the two turns of the probe."""
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE), (PROBE_ID, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Digest of every conversation of a table of turns, by way of its log."""
    return digest(format_log(cut(log_of(conversations), "chat-log")))


ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role, '[<\[]\\*(?:{_REST})')) + len(regexp_extract_all(text, '[<\[]\\*(?:{_REST})')) + {len(TURN) + len(SAY) + len(END)} AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

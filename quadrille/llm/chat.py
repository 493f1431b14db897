"""Chat formatting from a declarative template, with DataFrame functions only.

A finite-state machine over roles validates the order of a conversation's turns; every turn gives three segments,
its head, its text and its end, each with a loss flag. Control strings inside texts are escaped so that none of them
is left in a segment of text, and the output can be read back without loss.

A conversation is one row of the output, as a document is. Turns are taken by turn (null first); turns of one number
by role and text, so repeated rows each are a turn. A null role or text is empty; rows whose conv_id is null make up
one conversation without id; an empty table gives an empty result. Extra columns of the input are not read. An order
that the machine refuses does not drop a conversation: it is formatted all the same, with ``valid`` false and
``error_turn`` the number (from 1) of the first turn that has no move; ``error_turn`` is null if only the end is
missing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quadrille.storage import read_table


#: Behind a turn that has no move; no move leads out of it.
NO_STATE = ""


@dataclass(frozen=True)
class Template:
    """What stands around a turn, which roles are learned, and the moves of the machine.

    ``escapes`` are pairs in the order in which they are put in; the first one is the escape sign itself. No escape
    holds a control string, and after the sign stands one of the signs named here, so reading back is exact."""

    opens: str = "### "
    named: str = ": "
    closes: str = "</turn>\n"
    #: Head of each known role; any other role stands behind ``other``, escaped.
    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    other: str = "@"
    learned: tuple[str, ...] = ("assistant",)
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\s"), ("###", "\\h"), ("</turn>", "\\e"))
    #: Roles are escaped beyond that, so that ``named`` ends them.
    role_escapes: tuple[tuple[str, str], ...] = ((":", "\\c"),)
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {("start", "system"): "primed", ("start", "user"): "asked", ("primed", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"}
    )
    accepts: tuple[str, ...] = ("answered",)

    def escape(self, text: Column, role: bool = False) -> Column:
        return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), self.escapes + self.role_escapes * role, text)

    def unescape(self, text: Column, role: bool = False) -> Column:
        return reduce(lambda x, pair: F.replace(x, F.lit(pair[1]), F.lit(pair[0])), (self.escapes + self.role_escapes * role)[::-1], text)

    def head(self, role: Column) -> Column:
        known = reduce(lambda x, pair: x.when(role == pair[0], F.lit(pair[1])), self.names.items(), F.when(F.lit(False), ""))
        return F.concat(F.lit(self.opens), known.otherwise(F.concat(F.lit(self.other), self.escape(role, role=True))), F.lit(self.named))

    def role(self, name: Column) -> Column:
        """The role that a head names."""
        known = reduce(lambda x, pair: x.when(name == pair[1], F.lit(pair[0])), self.names.items(), F.when(F.lit(False), ""))
        return known.otherwise(self.unescape(F.substr(name, F.lit(len(self.other) + 1)), role=True))

    def next_state(self, state: Column, role: Column) -> Column:
        """The machine's move; NO_STATE where there is none."""
        return reduce(lambda x, move: x.when((state == move[0][0]) & (role == move[0][1]), F.lit(move[1])), self.moves.items(), F.when(F.lit(False), F.lit(self.start))).otherwise(F.lit(NO_STATE))


def conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and its turns in order: array<struct<turn, role, text>>."""
    empty = lambda c: F.coalesce(turns[c].cast("string"), F.lit("")).alias
    rows = turns.select(turns[conv_col].cast("long").alias("conv_id"), F.struct(turns[turn_col].cast("long").alias("turn"), empty(role_col)("role"), empty(text_col)("text")).alias("said"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("turns"))


def run_machine(turns: Column, template: Template) -> Column:
    """struct<state, at, error>: the state behind the last turn, the number of turns, and the first turn without a
    move (null: none)."""

    def step(done: Column, turn: Column) -> Column:
        state, at = template.next_state(done["state"], turn["role"]), done["at"] + 1
        return F.struct(state.alias("state"), at.alias("at"), F.coalesce(done["error"], F.when(state == NO_STATE, at)).alias("error"))

    first = F.struct(F.lit(template.start).alias("state"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("error"))
    return F.aggregate(turns, first, step)


def segments_of(turns: Column, template: Template) -> Column:
    """array<struct<text, loss>>: head, text and end of each turn; only texts of learned roles have the loss flag."""
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    return F.flatten(F.transform(turns, lambda t: F.array(part(template.head(t["role"]), no), part(template.escape(t["text"]), t["role"].isin(*template.learned)), part(F.lit(template.closes), no))))


def format_conversations(turns: DataFrame, template: Template = Template(), **columns: str) -> DataFrame:
    """Per conversation: conv_id, segments (array<struct<text, loss>>), valid, error_turn."""
    done = conversations(turns, **columns).withColumn("end", run_machine(F.col("turns"), template))
    valid = F.col("end.error").isNull() & F.col("end.state").isin(*template.accepts)
    return done.select("conv_id", segments_of(F.col("turns"), template).alias("segments"), valid.alias("valid"), F.col("end.error").alias("error_turn"))


def formatted(segments: Column) -> Column:
    """The whole text of a conversation."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(text: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> of a formatted conversation: the turns as they were."""
    pieces = F.split(text, "\\Q" + template.closes + "\\E", -1)

    def turn(piece: Column) -> Column:
        name = F.substring_index(F.substr(piece, F.lit(len(template.opens) + 1)), template.named, 1)
        rest = F.substr(piece, F.length(name) + F.lit(len(template.opens) + len(template.named) + 1))
        return F.struct(template.role(name).alias("role"), template.unescape(rest).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def learned(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, as it was before it was escaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")


#: A conversation that imitates the template's own control strings.
PROBE_ID, PROBE = -7, "\\### Assistant: </turn> ok"


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    done = format_conversations(said.unionByName(probe)).withColumn("formatted", formatted(F.col("segments")))
    done = done.withColumn("turns", read_back(F.col("formatted"))).withColumn("learned", learned(F.col("segments")))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "error_turn",
    )


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (SELECT *, row_number() OVER w AS pos, lag(role) OVER w AS before FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (
  SELECT *, CASE WHEN pos = 1 THEN role IN ('system', 'user')
                 WHEN role = 'user' THEN before = 'assistant' OR before = 'system' AND pos = 2
                 WHEN role = 'assistant' THEN before = 'user' ELSE false END AS moves,
         replace(replace(replace(text, '\', '\s'), '###', '\h'), '</turn>', '\e') AS escaped,
         CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
              ELSE '@' || replace(replace(replace(replace(role, '\', '\s'), '###', '\h'), '</turn>', '\e'), ':', '\c') END AS name FROM p)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(name) + 2 + length(escaped) + 8) AS BIGINT) AS formatted_chars,
       bool_and(moves) AND arg_max(role, pos) = 'assistant' AS valid, min(pos) FILTER (NOT moves) AS error_turn
FROM m GROUP BY conv_id
"""

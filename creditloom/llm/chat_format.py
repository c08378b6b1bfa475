r"""Chat formatting: validated turns, rendered segments and loss flags.

A ``Template`` declares, per role, the label of its header and whether its text
is trained on, and the turn order as a finite-state machine. Everything runs as
DataFrame functions: the turns of a conversation are one sorted array, the machine
is a fold over it, and the segments are a transform of it.

Control strings inside texts are escaped reversibly: each backslash is
doubled, and a backslash is put into each ``</turn>`` and each ``### ``. Dropping the
backslash before any character undoes both. Labels of undeclared roles are
``@`` and the role with ``\``, ``:`` and ``<`` spelt ``\b``, ``\c`` and ``\l``.

Rows: null text and null role count as empty; a null conv_id is a conversation of
its own; turns sort by (turn, role, text), nulls first, so ties and repeated
rows have one order and all stay; an undeclared role makes the conversation
invalid but is rendered and read back; empty tables give empty results; further columns
are ignored. A conversation must fit into one row: its digest runs over all of it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creditloom.llm.common import query, read

_END = "</turn>"
_HEAD = "### "
_PROBE = r"\### Assistant: </turn> ok"


@dataclass(frozen=True)
class Template:
    """Roles with their label and loss flag, and the machine of turn order."""

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    trained: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "briefed", ("start", "user"): "asked", ("briefed", "user"): "asked",
            ("asked", "assistant"): "answered", ("answered", "user"): "asked",
        }
    )
    accepting: frozenset[str] = frozenset({"asked", "answered"})


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    ended = F.replace(doubled, F.lit(_END), F.lit(_END[0] + "\\" + _END[1:]))
    return F.replace(ended, F.lit(_HEAD), F.lit(_HEAD[0] + "\\" + _HEAD[1:]))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


_SPELT = (("\\", "\\b"), (":", "\\c"), ("<", "\\l"))


def _label(role: Column, template: Template) -> Column:
    spelt = role
    for plain, code in _SPELT:
        spelt = F.replace(spelt, F.lit(plain), F.lit(code))
    known = F.create_map(*[F.lit(x) for pair in template.labels.items() for x in pair])
    return F.coalesce(F.try_element_at(known, role), F.concat(F.lit("@"), spelt))


def _role(label: Column, template: Template) -> Column:
    plain = F.substring(label, 2, 1 << 30)
    for sign, code in reversed(_SPELT):
        plain = F.replace(plain, F.lit(code), F.lit(sign))
    known = F.create_map(*[F.lit(x) for role, name in template.labels.items() for x in (name, role)])
    return F.coalesce(F.try_element_at(known, label), plain)


def format_chats(chats: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, valid, end_state, segments, formatted.

    ``segments`` is an array of (text, loss) in order: header, text and end of
    each turn; ``formatted`` is their texts in a row. ``valid``: the machine
    accepts the roles.
    """
    template = template or Template()
    rows = chats.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t")
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    state = F.aggregate(
        "turns",
        F.lit(template.start),
        lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), t["role"])), F.lit("refused")),
    )

    def render(t: Column) -> Column:
        def segment(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        no = F.lit(False)
        return F.array(
            segment(F.concat(F.lit(_HEAD), _label(t["role"], template), F.lit(": ")), no),
            segment(escape(t["text"]), t["role"].isin(*template.trained)),
            segment(F.lit(_END + "\n"), no),
        )

    return (
        turns.select("conv_id", state.alias("end_state"), F.flatten(F.transform("turns", render)).alias("segments"))
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
        .select("conv_id", F.col("end_state").isin(*template.accepting).alias("valid"), "end_state", "segments", "formatted")
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """Array of (role, text) recovered from a formatted conversation."""
    template = template or Template()
    pieces = F.filter(F.split(formatted, _END + "\n"), lambda p: p != "")

    def turn(p: Column) -> Column:
        label = F.regexp_extract(p, r"^### ([^:]*): ", 1)
        body = F.substr(p, F.length(label) + F.lit(len(_HEAD) + 3))
        return F.struct(_role(label, template).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")


_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'system' THEN 'System'
    ELSE '@' || replace(replace(replace(role, '\', '\b'), ':', '\c'), '<', '\l') END AS label,
    replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## ') AS escaped
  FROM rows
), whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(label) + length(escaped) + 14)::BIGINT AS formatted_chars
  FROM marked GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM whole
"""


@query("op5_chat_format", _SQL)
def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    roles = F.when(F.col("id") == 0, "user").otherwise("assistant")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), F.lit(_PROBE).alias("text"))
    out = format_chats(given.unionByName(probe)).select(
        "conv_id", read_back(F.col("formatted")).alias("turns"), trained_text(F.col("segments")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars")
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )

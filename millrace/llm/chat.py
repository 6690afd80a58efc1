r"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names, for each role, the header before a turn, the marker after
it and whether its text is trained on. A turn becomes three segments: header
and marker without loss, and the escaped text with the role's loss flag. The
machine's states are roles; a move that the template doesn't list makes the
conversation invalid from that turn on, which is reported beside the
segments: nothing is dropped.

Escapes: a backslash is doubled, "##" becomes "#\#" and "</" becomes "<\/", so
that neither "###" nor "</turn>" can stand in a text; taking the backslash away
from every escaped character restores it.

All of it is DataFrame functions. A conversation is one row of output, hence
its turns meet in one row; nothing larger does.

Defined cases: null text is empty, null role is "" (like any role that the
template doesn't name it gets a header of its own, escaped); turns of equal
number go by role and text, null first; rows of null conv_id are one
conversation; repeated rows are repeated turns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    headers: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    before: str = "### "
    between: str = ": "
    after: str = "</turn>"
    trained: tuple[str, ...] = ("assistant",)
    #: from each state the roles that may follow; "" is the start
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user", "tool"), "tool": ("assistant",)})
    ends: tuple[str, ...] = ("assistant",)


INVALID = "!"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(c, F.lit("##"), F.lit("#\\#")), F.lit("</"), F.lit("<\\/"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def _known(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def header(role: Column, t: Template) -> Column:
    other = F.concat(F.lit("="), F.replace(escape(role), F.lit(":"), F.lit("\\:")))
    return F.concat(F.lit(t.before), F.coalesce(F.try_element_at(_known(t.headers), role), other), F.lit(t.between))


def role_of(label: Column, t: Template) -> Column:
    known = F.try_element_at(_known({v: k for k, v in t.headers.items()}), label)
    return F.coalesce(known, unescape(F.substring(label, 2, 1 << 30)))


def format_chats(rows: DataFrame, t: Template = Template()) -> DataFrame:
    """Of rows (conv_id, turn, role, text): conv_id, segments (text, loss), formatted, valid, wrong_turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    moves = _known({f"{a}>{b}": b for a, bs in t.moves.items() for b in bs})
    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("wrong"))

    def move(s: Column, x: Column) -> Column:
        to = F.coalesce(F.try_element_at(moves, F.concat(s["state"], F.lit(">"), x["role"])), F.lit(INVALID))
        wrong = F.coalesce(s["wrong"], F.when(to == INVALID, s["n"]))
        return F.struct(to.alias("state"), (s["n"] + 1).alias("n"), wrong.alias("wrong"))

    def cut(x: Column) -> Column:
        loss = x["role"].isin(*t.trained)
        no = F.lit(False)
        return F.array(F.struct(header(x["role"], t).alias("text"), no.alias("loss")), F.struct(escape(x["text"]).alias("text"), loss.alias("loss")), F.struct(F.lit(t.after).alias("text"), no.alias("loss")))

    end = F.aggregate("turns", start, move)
    out = turns.select("conv_id", F.flatten(F.transform("turns", cut)).alias("segments"), end.alias("end"))
    joined = F.array_join(F.transform("segments", lambda x: x["text"]), "")
    return out.select("conv_id", "segments", joined.alias("formatted"), (F.col("end.wrong").isNull() & F.col("end.state").isin(*t.ends)).alias("valid"), F.col("end.wrong").alias("wrong_turn"))


def parse_chats(formatted: DataFrame, t: Template = Template()) -> DataFrame:
    """Back from the output: conv_id, turns (role, text), trained (all text under the loss mask)."""
    parts = F.filter(F.split("formatted", t.after), lambda x: x != "")

    def turn(x: Column) -> Column:
        at = F.instr(x, t.between)
        label = F.substr(x, F.lit(len(t.before) + 1), at - (len(t.before) + 1))
        text = F.substr(x, at + len(t.between), F.length(x))
        return F.struct(role_of(label, t).alias("role"), unescape(text).alias("text"))

    loss = F.array_join(F.transform(F.filter("segments", lambda x: x["loss"]), lambda x: unescape(x["text"])), "")
    rest = [c for c in formatted.columns if c not in ("turns", "trained")]
    return formatted.select(*rest, F.transform(parts, turn).alias("turns"), loss.alias("trained"))


def op7_chat(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    said = r"\### Assistant: </turn> ok"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    got = parse_chats(format_chats(rows.unionByName(more)))
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return got.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")


_ESCAPED = r"replace(replace(replace(coalesce({}, ''), '\', '\\'), '##', '#\#'), '</', '<\/')"

OP7_SQL = rf"""
WITH c AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
    lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS prev,
    CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role)
      ELSE 1 + length(replace({_ESCAPED.format('role')}, ':', '\:')) END AS label
  FROM c
), d AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '') AS trained,
    CAST(sum(4 + label + 2 + length({_ESCAPED.format('text')}) + 7) AS BIGINT) AS formatted_chars,
    bool_and(CASE prev WHEN '' THEN n = 1 AND role IN ('system', 'user') WHEN 'system' THEN role = 'user'
      WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role IN ('user', 'tool')
      WHEN 'tool' THEN role = 'assistant' ELSE FALSE END) AND arg_max(role, n) = 'assistant' AS valid
  FROM o GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(trained) AS BIGINT) AS loss_chars,
  sha256(trained) AS loss_sha256, formatted_chars, valid FROM d
"""

"""Chat formatting with column expressions only: a role automaton, text segments with loss flags, and the way back.

A template is data: for each role the name that marks its turns and whether its
text is under the loss; marks around a turn; and the automaton's transitions.
Backslash, `#` and `<` inside texts become two characters each, so neither mark
can occur in a text, and the formatted string alone gives back all turns.

Defined results: null text is empty; a null role is the empty role, which like
every role outside the template is written behind `=`; turns with the same
number are ordered by role, then text; repeated rows stay; a null conversation
id is a conversation of its own; other columns are not read. A conversation is
one record, since its output is one string: it is what one task must hold.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))  # in this order; undone in reverse


@dataclass(frozen=True)
class Template:
    """roles: role -> (name in the mark, under the loss); moves: state -> role -> next state."""

    roles: dict[str, tuple[str, bool]] = field(default_factory=lambda: {"system": ("System", False), "user": ("User", False), "assistant": ("Assistant", True)})
    start: str = "### "
    stop: str = "</turn>\n"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {"start": {"system": "system", "user": "user"}, "system": {"user": "user"}, "user": {"assistant": "assistant"}, "assistant": {"user": "user"}}
    )
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if "#" not in self.start or "<" not in self.stop or any(":" in n or n.startswith("=") for n, _ in self.roles.values()):
            raise ValueError("marks need a character that texts escape, names none that ends them")


def _replaced(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def escaped(c: Column, codes=_CODES[:3]) -> Column:
    return _replaced(c, codes)


def unescaped(c: Column, codes=_CODES[:3]) -> Column:
    return _replaced(c, [(b, a) for a, b in reversed(codes)])


def _map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, formatted, segments (text, loss), state (last state of the automaton), valid."""
    t = template
    rows = turns.select("conv_id", F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    names, loss = _map({r: n for r, (n, _) in t.roles.items()}), _map({r: on for r, (_, on) in t.roles.items()})
    steps = _map({f"{s} {r}": n for s, by in t.moves.items() for r, n in by.items()})

    def segments(x: Column) -> Column:
        name = F.coalesce(F.try_element_at(names, x["role"]), F.concat(F.lit("="), escaped(x["role"], _CODES)))
        on = F.coalesce(F.try_element_at(loss, x["role"]), F.lit(False))
        parts = [(F.concat(F.lit(t.start), name, F.lit(": ")), F.lit(False)), (escaped(x["text"]), on), (F.lit(t.stop), F.lit(False))]
        return F.array(*[F.struct(a.alias("text"), b.alias("loss")) for a, b in parts])

    state = F.aggregate("turns", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(steps, F.concat_ws(" ", s, x["role"])), F.lit("broken")))
    out = one.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), state.alias("state"))
    return out.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "state", F.col("state").isin(*t.final).alias("valid"))


def turns_of(text: str, template: Template = Template()) -> Column:
    """The (role, text) turns of a formatted column."""
    t = template
    names = _map({n: r for r, (n, _) in t.roles.items()})
    marked = F.filter(F.split(F.col(text), t.stop, -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        name = F.substring_index(x.substr(F.lit(len(t.start) + 1), F.length(x)), ": ", 1)
        body = x.substr(F.lit(len(t.start) + 3) + F.length(name), F.length(x))
        role = F.coalesce(F.try_element_at(names, name), unescaped(name.substr(F.lit(2), F.length(name)), _CODES))
        return F.struct(role.alias("role"), unescaped(body).alias("text"))

    return F.transform(marked, turn)


def loss_text(segments: str) -> Column:
    """All text under the loss mask, unescaped."""
    return unescaped(F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: s["text"]), ""))


def digests(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """What the output says of itself, read back from it."""
    back = formatted.select("conv_id", "formatted", "state", "valid", turns_of("formatted", template).alias("turns"), loss_text("segments").alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


TRICKY = "\\### Assistant: </turn> ok"

ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
w AS (SELECT *, lag(role) OVER o AS was, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS last FROM c
      WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
m AS (SELECT *, replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') AS esc,
             CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant'
                  ELSE '=' || replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') END AS name,
             coalesce(CASE WHEN was IS NULL THEN role IN ('system', 'user') WHEN was IN ('system', 'assistant') THEN role = 'user'
                  WHEN was = 'user' THEN role = 'assistant' END, false) AS ok FROM w)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(name) + length(esc) + 14) AS BIGINT) AS formatted_chars,
       bool_and(ok) AND max(CASE WHEN last THEN role END) = 'assistant' AS valid
FROM m GROUP BY conv_id"""

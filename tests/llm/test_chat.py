import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from spoor.llm import chat

KIND = "conv_id long, turn long, role string, text string"


def test_round_trip_and_digests(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", chat.TRICKY), (1, 2, "assistant", "</turn>\n### User: \\b\\\\l<#"), (2, 0, "assistant", "first"), (3, 1, "tool: =x", None), (3, 0, None, "é😀"), (None, None, "user", ""), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, 0, "user", "x" * 300_000)]
    df = spark.createDataFrame(rows, KIND).selectExpr("*", "turn AS segments", "role AS state", "text AS formatted")
    out = chat.formatted(df)
    turns = {r.conv_id: r.turns for r in out.select("conv_id", chat.turns_of("formatted").alias("turns")).collect()}
    for c in (1, 2, 3, None, 4, 5):
        own = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t.role, t.text) for t in turns[c]] == [(r[2] or "", r[3] or "") for r in own]
    got = {r.conv_id: r for r in chat.digests(out).collect()}
    said = "</turn>\n### User: \\b\\\\l<#"
    assert got[1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[1].loss_chars == len(said)
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in rows[:3]).encode()).hexdigest()
    assert [got[c].valid for c in (1, 2, 3, None, 4)] == [True, False, False, False, False]
    flags = {r.conv_id: [(s.text, s.loss) for s in r.segments] for r in out.collect()}
    assert all("".join(t for t, _ in flags[r.conv_id]) == r.formatted for r in out.collect())
    assert [x for x in flags[2] if x[1]] == [("first", True)]
    assert all(len(r.formatted) == got[r.conv_id].formatted_chars for r in out.collect())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "tool", "a:b", "=", "\\"]), st.text(alphabet="\\#<>/turn: =\nbhlc", max_size=30)), min_size=1, max_size=20))
def test_any_text_comes_back(spark, turns):
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], KIND)
    row = chat.formatted(df).select(chat.turns_of("formatted").alias("t"), "formatted").first()
    assert [(x.role, x.text) for x in row.t] == turns
    assert row.formatted.count("</turn>\n") == len(turns)


def test_empty(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], KIND))).collect() == []

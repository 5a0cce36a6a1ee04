import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectraweave.llm import conversations as cv
from spectraweave.llm.queries import TURNS_SQL, op11_conversations

STEP = {("b", "s"): "s", ("b", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
DUE = {"b": "u", "s": "u", "u": "a", "a": "u"}


def brute(turns):
    """The least (cost, audit) over all edits, by the states of an automaton for the grammar."""

    def take(states, key, cost, audit):
        if key not in states or (cost, audit) < states[key]:
            states[key] = cost, audit

    def inserted(states):
        for _ in range(4):
            for key, (cost, audit) in list(states.items()):
                take(states, STEP[key, DUE[key]], cost + 2, audit + "I")
        return states

    states = {"b": (0, "")}
    for (role, _), fault in zip(turns, cv.faults(turns)):
        after = {}
        for key, (cost, audit) in inserted(states).items():
            take(after, key, cost + 3, audit + "D")
            if fault in ("", "truncated"):
                more = cost + (fault == "truncated")
                if (key, role[:1]) in STEP:
                    take(after, STEP[key, role[:1]], more, audit + "K")
                take(after, STEP[key, DUE[key]], more + 2, audit + "R")
        states = after
    states = inserted(states)
    return min(states[k] for k in "ba" if k in states)


turn = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "user", "assistant", ""]), st.sampled_from(["a.", "b!", "c?", "d.", "e.", "f", "", " \n", "g", "h."]))


@settings(max_examples=500, deadline=None)
@given(st.lists(turn, max_size=14))
def test_repair_equals_brute_force(turns):
    cost, audit, mended = cv.repaired(turns)
    assert (cost, audit) == brute(turns)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in mended))
    assert [t for r, t in mended if t] == [t for (r, t), e in zip(turns, audit.replace("I", "")) if e != "D"]
    assert cv.incumbent("".join(r[:1] or "-" for r, _ in turns), cv.faults(turns)) >= cost


@pytest.mark.parametrize("block", [1, 7, 256])
def test_long_conversations_by_blocks(monkeypatch, block):
    monkeypatch.setattr(cv, "_BLOCK", block)
    turns = [("system", "Be kind.")] + [("user" if (k % 2 == 0) != (k % 11 == 0) else "assistant", f"{k}" + "." * (k % 7 > 0)) for k in range(700) if k % 13]
    cost, audit, _ = cv.repaired(turns)
    assert (cost, audit) == brute(turns)
    assert cv.repaired([("user", f"{k}.") for k in range(90)])[0] == 90


def test_edits_by_hand():
    assert cv.repaired([]) == (0, "", [])
    assert cv.repaired([("system", "s.")]) == (3, "D", [])
    assert cv.repaired([("system", "s."), ("user", "u.")]) == (2, "KKI", [("system", "s."), ("user", "u."), ("assistant", "")])
    assert cv.repaired([("assistant", "a.")])[:2] == (2, "IK")
    assert cv.faults([("user", "a"), ("user", "a"), ("user", " "), ("x", "a? \n")]) == ["truncated", "duplicate", "blank", ""]


def test_edges(spark):
    rows = [
        (1, None, "user", "Hello."), (1, 0, "assistant", "Hi."), (1, 5, None, None), (2, 3, "user", "One."), (2, 3, "user", "One."), (None, 1, "user", "x" * 300_000 + "."),
        (3, 1, "gone", "gone"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'z' as repaired", "1 as turns", "2 as gaps")
    got = {r.conv_id: r for r in cv.repair(df, present=df.conv_id.isNull() | (df.conv_id != 3)).collect()}
    assert len(got) == 4
    assert (got[1].gaps, got[1].blank, got[1].illegal, got[1].cost, got[1].audit) == (4, 1, 1, 3, "KKD")
    assert (got[2].gaps, got[2].duplicate, got[2].illegal, got[2].audit) == (0, 1, 1, "KDI")
    assert (got[None].truncated, got[None].audit, len(got[None].repaired[0].text)) == (0, "KI", 300_001)
    assert tuple(got[3])[1:] == (0, 0, 0, 0, 0, 0, "", [])
    assert cv.repair(df.limit(0)).count() == 0


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from read_parquet('{sf}/conversations.parquet')")
    got, want = op11_conversations(spark, sf), con.sql(TURNS_SQL)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())

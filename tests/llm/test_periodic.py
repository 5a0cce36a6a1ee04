import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from spectraweave.llm import periodic
from spectraweave.llm.queries import RUNS_SQL, op12_periodic_runs


def brute(words, least=6, periods=4):
    """All runs, by comparing the words with themselves at every distance."""
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


letters = st.lists(st.sampled_from("ab"), max_size=40) | st.lists(st.sampled_from("abcd"), max_size=40)
looped = st.builds(lambda head, loop, times, tail: head + loop * times + tail, letters, st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 9), letters)


@settings(max_examples=400, deadline=None)
@given(st.lists(letters | looped, max_size=5))
def test_runs_equal_brute_force(texts):
    assert periodic.found(texts) == [brute(w) for w in texts]


@pytest.mark.parametrize("least,periods", [(6, 5), (12, 4), (9, 7)])
def test_other_limits(least, periods):
    words = list("ababababababab" + "c" * 11 + "abcabcabcabcabcabcab" + "xyzwv" * 5)
    assert periodic.found([words], least, periods) == [brute(words, least, periods)]


def test_long_texts():
    assert periodic.found([["a"] * 30_000, ["a", "b"] * 20_000]) == [[(0, 30_000, 1)], [(0, 40_000, 2)]]
    # one common passage after as many different words: no run, and no work for each pair of places
    words = [w for k in range(20_000) for w in ("five", "words", "in", "a", "row", str(k))]
    assert periodic.found([words]) == [[]]


def test_collapsed():
    words = list("xababababyabab")
    assert "".join(periodic.collapsed(words, periodic.found([words])[0])) == "xabyabab"
    assert periodic.collapsed(["a"], []) == ["a"]


def test_edges(spark):
    rows = [(1, None, 1, 5), (2, "", 1, 6), (3, " \n", None, 7), (4, "a\u00a0b " * 8, 1, 8), (4, "a\u00a0b " * 8, 1, 8), (5, "one two three", 1, 9)]
    got = periodic.with_runs(spark.createDataFrame(rows, "doc_id long, text string, Runs int, n int")).orderBy("doc_id").collect()
    assert [list(map(tuple, r.runs)) for r in got] == [[], [], [], [(0, 8, 1)], [(0, 8, 1)], []]
    assert [r.collapsed for r in got] == ["", "", "", "a\u00a0b", "a\u00a0b", "one two three"] and [r.n for r in got] == [5, 6, 7, 8, 8, 9]
    assert got[0].text is None and len(got[0]) == 5
    assert periodic.with_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        periodic.with_runs(spark.createDataFrame([], "text string"), periods=2)


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got, want = op12_periodic_runs(spark, sf), con.sql(RUNS_SQL)
    assert got.columns == want.columns and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))

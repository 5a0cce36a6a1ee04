import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spectraweave.llm import mixing
from spectraweave.llm.queries import op2_mix_sources


def share_again(sizes, weights, total, most):
    """The definition, round by round."""
    out, full = {}, set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        pool = sum(weights[s] for s in sizes if s not in full)
        out = {s: most * sizes[s] if s in full else left * weights[s] / pool for s in sizes}
        over = {s for s in sizes if s not in full and out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def check(rows, total=1.5):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["n"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = share_again(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, total * sum(sizes.values()), 2)
    for s in sizes:
        mine = sorted((r for r in rows if r["source"] == s), key=lambda r: hashlib.md5(f"7:{r['doc_id']}".encode()).hexdigest())
        whole = min(2, int(want[s] / sizes[s])) if sizes[s] else 0
        rest, at = want[s] - whole * sizes[s], 0
        for r in mine:
            at += r["n"]
            assert r["taken"] == r["n"] * min(2, whole + (at - r["n"] / 2 <= rest)), r
            assert r["target"] == pytest.approx(want[s])
            assert r["source_size"] == sizes[s]
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max([r["n"] for r in mine], default=0)


def test_query_against_the_definition(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r.asDict() | {"source": docs[r.doc_id].source, "n": r["size"]} for r in op2_mix_sources(spark, sf).collect()]
    assert len(rows) == len(docs)
    assert all(r["n"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r["doc_id"]].text)) for r in rows)
    check(rows)
    again = op2_mix_sources(spark, sf).select("doc_id", "taken").collect()
    assert {(r["doc_id"], r["taken"]) for r in rows} == {tuple(r) for r in again}


def test_edges(spark):
    data = [(1, "a b c", "x"), (2, None, "x"), (3, "", None), (4, "d e f", None), (None, "g h", "y"), (6, "i " * 50_000, "y"), (7, "k", "Z")]
    df = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, source string, taken int, bin int")
    got = mixing.mix(df, F.array("source"), mixing.word_count(F.col("text")), bins=16).collect()
    assert sorted((str(r.doc_id), r["size"]) for r in got) == [("1", 3), ("2", 0), ("3", 0), ("4", 2), ("6", 50_000), ("7", 1), ("None", 2)]
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert mixing.mix(df.limit(0), F.array("source"), mixing.word_count(F.col("text"))).count() == 0
    twice = mixing.mix(df.union(df), F.array("source"), mixing.word_count(F.col("text")))
    assert twice.count() == 14


def test_flow_reroutes_shared_patterns():
    f = frozenset
    sizes = {f("a"): 10.0, f("ab"): 10.0, f("bc"): 10.0}
    flow = mixing.min_cost_flow(sizes, {"a": 10.0, "b": 10.0, "c": 10.0}, 2)
    assert sum(flow.values()) == pytest.approx(30)
    for p in sizes:
        assert sum(x for (q, _), x in flow.items() if q == p) == pytest.approx(10)  # nothing is repeated: a, b and c are met at cost 0
    flow = mixing.min_cost_flow(sizes, {"a": 25.0, "b": 0.0, "c": 0.0}, 2)
    assert flow[f("a"), "a"] + flow[f("ab"), "a"] == pytest.approx(25)
    assert flow[f("a"), "a"] <= 20 and flow[f("ab"), "a"] <= 20


def test_overlapping_sources_reach_their_targets(spark):
    rows = [(i, "w " * (1 + i % 7), [["a"], ["a", "b"], ["b", "c"], ["c"], [None, "a"]][i % 5]) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, of array<string>")
    got = mixing.mix(df, F.col("of"), mixing.word_count(F.col("text"))).collect()
    taken, size = sum(r.taken for r in got), sum(r["size"] for r in got)
    assert abs(taken - 1.5 * size) <= 7 * 5
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in got)

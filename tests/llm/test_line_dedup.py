import pytest
from pyspark.sql import functions as F

from spectraweave.llm import line_dedup


def within(a, b, k):
    if abs(len(a) - len(b)) > k:
        return False
    row = {j: j for j in range(k + 1)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            new[j] = i if j == 0 else min(row.get(j, 99) + 1, new.get(j - 1, 99) + 1, row.get(j - 1, 99) + (x != b[j - 1]))
        row = new
        if min(row.values()) > k:
            return False
    return row[len(b)] <= k


def by_hand(docs, k=2, least=40):
    """New texts by (id, text), with every line compared with every earlier one."""
    lines = sorted({(d, t, p, x.strip(" ").lower()) for d, t in docs if t is not None for p, x in enumerate(t.split("\n"))}, key=lambda r: (r[0], hash_of[r[1]], r[2]))
    lines = [r for r in lines if len(r[3]) >= least]
    gone, seen, by_length = set(), {}, {}
    for d, t, p, x in lines:
        if x not in seen:
            seen[x] = any(within(x, y, k) for n in range(len(x) - k, len(x) + k + 1) for y in by_length.get(n, ()))
            if seen[x]:
                gone.add((d, t, p))
            by_length.setdefault(len(x), []).append(x)
        else:
            gone.add((d, t, p))
    return sorted((d, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, t, p) not in gone)) for d, t in docs)


hash_of = {}


def hashes(spark, docs):
    hash_of.update({r.text: r.h for r in spark.createDataFrame([(t,) for _, t in docs if t is not None], "text string").select("text", F.xxhash64("text").alias("h")).collect()})


def test_whole_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    hashes(spark, docs)
    got = sorted((r.doc_id, r.text) for r in line_dedup.deduplicated(df).collect())
    assert got == by_hand(docs) and got != sorted(docs)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_edits_at_every_place(spark, k):
    base = "abcdefghijklmnopqrstuvwxyz 0123456789 the quick brown fox"
    texts = [base]
    for n in range(1, k + 2):
        for i in range(0, len(base) - 8, 3):
            s = list(base)
            for j in range(n):
                if (i + j) % 3 == 0:
                    s[i + 2 * j] = "#"
                elif (i + j) % 3 == 1:
                    s[i + 2 * j] += "é"
                else:
                    s[i + 2 * j] = ""
            texts.append("".join(s))
    docs = list(enumerate(texts, 1))
    hashes(spark, docs)
    got = sorted((r.doc_id, r.text) for r in line_dedup.deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), distance=k).collect())
    assert got == by_hand(docs, k)


def test_edges(spark):
    line, near, short = "A line of text that is long enough to be looked at.", " a line of text that is long enough to be Looked at!", "short"
    docs = [(3, line), (1, None), (2, ""), (5, f"{near}\n{short}\nnew words in a line that nobody has written before"), (5, f"{near}\n{short}\nnew words in a line that nobody has written before"), (6, f"{short}\n{line}\n{line}"), (7, "z" * 300_000)]
    df = spark.createDataFrame([(*d, "x", 0) for d in docs], "doc_id long, text string, tag string, pos int")
    hashes(spark, docs)
    out = line_dedup.deduplicated(df, removed_col="removed")
    assert out.columns == ["doc_id", "text", "tag", "pos", "removed"]
    got = out.collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(by_hand([d for d in docs if d[0]]), key=str)
    assert {(r.doc_id, tuple(r.removed)) for r in got} == {(3, ()), (1, ()), (2, ()), (5, (0,)), (6, (1, 2)), (7, ())}
    assert line_dedup.deduplicated(df.limit(0)).count() == 0
    lone = spark.createDataFrame([(None, line), (4, line)], "doc_id long, text string")
    assert {(r.doc_id, r.text) for r in line_dedup.deduplicated(lone).collect()} == {(None, line), (4, "")}
    with pytest.raises(ValueError):
        line_dedup.deduplicated(df, min_chars=5)


def test_native(spark, sf):
    df = line_dedup.deduplicated(spark.read.parquet(f"{sf}/documents.parquet"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan

import numpy as np
import pytest

import corpus_pipeline
from spectraweave.llm import simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(docs):
    """(id, smallest id reached by pairs of Jaccard similarity 0.8 or more), with every pair compared."""
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(docs):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted((d, low[find(i)]) for i, (d, _) in enumerate(docs))


def planted(seed=3):
    """Texts of 8 to 400 words and copies with words replaced, taken away at the end or put in, around similarity 0.8."""
    rng, docs = np.random.default_rng(seed), []
    for _ in range(60):
        base = [f"w{n}" for n in rng.integers(5000, size=int(rng.integers(8, 400)))]
        docs.append(base)
        for share in (0.01, 0.02, 0.03, 0.05):
            copy = list(base)
            for at in rng.integers(len(base), size=max(1, int(share * len(base)))):
                copy[at] = f"x{rng.integers(5000)}"
            docs.append(copy)
        docs += [base[: -max(1, len(base) // k)] for k in (5, 6, 8)]
    return [(n, " ".join(words)) for n, words in enumerate(docs)]


@pytest.mark.parametrize("limit, block", [(1, 1 << 16), (16, 1 << 16), (16, 600)])
def test_near_copies_against_brute_force(spark, monkeypatch, limit, block):
    monkeypatch.setattr(simhash, "FIRST_CANDIDATES", limit)
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = planted()
    got = simhash.near_copies(spark.createDataFrame(docs, "doc_id long, text string"), tile=32)
    assert sorted(map(tuple, got.collect())) == by_hand(docs)


def test_stage_finds_copies_beyond_four_bits(spark, sf):
    docs = planted(4)
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], SCHEMA)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, df, sf).collect())
    assert got == sorted({c for _, c in by_hand(docs)})
    by_contract = {r.component_id for r in simhash.near_duplicates(df).collect()}
    assert len(by_contract) > len(got)


def test_whole_table_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, simhash.near_copies(df, tile=16).collect())) == by_hand(docs)


def test_edges(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (7, "one two"), (7, "one two"), (None, "one two"), (8, "One TWO three")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, simhash.near_copies(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (7, 7), (7, 7), (None, 7), (8, 8)], key=str)
    assert simhash.near_copies(df.limit(0)).count() == 0

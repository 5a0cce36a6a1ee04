import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spectraweave.llm import simhash
from spectraweave.llm.common import connected_components

SCHEMA = "doc_id long, text string, fp string, hi int"


def by_hand(text, n=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(rows, radius):
    root = {i: i for i in range(len(rows))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted((str(d), low.get(find(i))) for i, (d, _) in enumerate(rows))


def test_whole_table_against_all_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = simhash.near_duplicates(docs, tile=16).collect()
    rows = [(r.doc_id, by_hand(r.text)) for r in docs.collect()]
    assert {(r.doc_id, r.fp & (1 << 64) - 1) for r in got} == set(rows)
    assert sorted((str(r.doc_id), r.component_id) for r in got) == components(rows, 4)


def test_edges(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    data = [(5, None), (3, ""), (9, " \n\t"), (7, "one two"), (7, "one two"), (None, "one two"), (8, long), (2, long + " x"), (4, "É É"), (6, "é é")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in data], SCHEMA)
    got = sorted((str(r.doc_id), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == components([(d, by_hand(t)) for d, t in data], 4)
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_matches_sparks_own_hash(spark):
    h = spark.range(1).select(F.xxhash64(F.lit("eins zwei drei vier")).alias("h")).first().h
    assert simhash.fingerprint_text("eins zwei DREI vier") == h & (1 << 64) - 1


@pytest.mark.parametrize("tile", [8, 64])
def test_dense_group_loses_no_link(spark, tile):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    values = {base}
    while len(values) < 150:
        values.add(int(rng.choice(list(values))) ^ (1 << int(rng.integers(62))) ^ (1 << int(rng.integers(62))))
    values |= {int(x) for x in rng.integers(1 << 62, size=50)}
    rows = [(v, v) for v in sorted(values)]
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), tile=tile)
    assert links.count() < 200 * 20
    root = {r.node: r.root for r in connected_components(links).collect()}
    want = {str(d): c for d, c in components(rows, 4)}
    assert {str(v): root.get(v, v) for v in values} == {k: c for k, c in want.items()}


def test_components_of_a_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = connected_components(edges.union(edges).union(spark.createDataFrame([(900, 900), (901, 905)], "u long, v long")))
    rows = {r.node: r.root for r in got.collect()}
    assert rows == {**{i: 0 for i in range(301)}, 901: 901, 905: 901}


def test_few_links_take_few_tasks(spark):
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        roots = connected_components(spark.createDataFrame([(k, k + 1) for k in range(40) if k % 10 != 9], "u long, v long"))
        assert roots.rdd.getNumPartitions() <= 8
        assert sorted(map(tuple, roots.collect())) == [(k, k - k % 10) for k in range(40)]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)

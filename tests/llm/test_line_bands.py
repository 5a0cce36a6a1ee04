import random

from pyspark.sql import functions as F

from spectraweave.llm import line_dedup
from spectraweave.llm.queries import op1_line_dedup


def within(a, b, k):
    if abs(len(a) - len(b)) > k:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1] <= k


def near(a, b, bands):
    for unit, least, greatest, k in bands:
        x, y = (a, b) if unit == "chars" else (a.split(" "), b.split(" "))
        if abs(len(x) - len(y)) <= k and least <= min(len(x), len(y)) <= (greatest or 10**9) and within(x, y, k):
            return True
    return False


def by_hand(docs, hash_of, least, bands):
    """New texts by (id, text), with every line compared with every earlier one."""
    lines = sorted({(d, hash_of[t], p, x.strip(" ").lower()) for d, t in docs for p, x in enumerate(t.split("\n"))})
    gone, earlier = set(), {}
    for d, h, p, x in lines:
        if len(x) >= least:
            if x not in earlier:
                earlier[x] = any(near(x, y, bands) for y in earlier)
                if not earlier[x]:
                    continue
            gone.add((d, h, p))
    return sorted((d, "\n".join(x for p, x in enumerate(t.split("\n")) if (d, hash_of[t], p) not in gone)) for d, t in docs)


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    hash_of = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    got = sorted((r.doc_id, r.text) for r in line_dedup.deduplicated(df, **line_dedup.WHOLE).collect())
    assert got == by_hand(docs, hash_of, line_dedup.WHOLE["min_chars"], line_dedup.WHOLE["bands"])
    return dict(got)


def test_replaced_words_in_long_lines(spark):
    rng, texts = random.Random(5), []
    for n in (19, 20, 21, 38, 39, 40, 41, 57, 78, 80, 83, 93, 159, 160, 165, 240):
        base = [f"word{rng.randrange(3000)}" for _ in range(n)]
        texts.append(base)
        for edits in (1, 2, 3, 4, 5, 8, 9):
            for _ in range(2):
                copy = list(base)
                for _ in range(edits):
                    at, how = rng.randrange(len(copy)), rng.randrange(3)
                    copy[at : at + (how != 0)] = [] if how == 2 else [f"other{rng.randrange(3000)}"]
                texts.append(copy)
    got = check(spark, [(i, " ".join(t)) for i, t in enumerate(texts)])
    assert got[7 * 15] and got[7 * 15 + 1] == ""  # 57 words, one replaced: beyond two characters


def test_shifts_to_both_sides(spark):
    base = [f"w{i}" for i in range(100)]
    docs = [(0, " ".join(base))]
    for at in range(0, 92, 3):
        for gap in (5, 17, 20):
            a, b, c = at, min(at + gap, 97), min(at + 2 * gap, 99)
            docs.append((len(docs), " ".join(base[:a] + base[a + 1 : b] + ["x", "y"] + base[b:c] + base[c + 1 :])))
    got = check(spark, docs)
    assert sum(t != "" for t in got.values()) == 1


def test_query_takes_the_bands(spark, tmp_path):
    words = [f"word{i}" for i in range(57)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:30] + ["another"] + words[31:]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.removed) for r in op1_line_dedup(spark, str(tmp_path)).collect()} == {(1, ""), (2, "0")}


def test_short_lines(spark):
    texts = ["yes\n\n1.\na heading of few words\n ", "Yes \n\n2.\nA heading of few word\n ", "no\n1.\na heading of many words", "nineteen characters\nyes\ntwenty characters no", "nineteen character\ntwenty characters n"]
    got = check(spark, list(enumerate(texts)))
    assert got[1] == "\n2.\n "  # empty lines stay, and so does another number
    assert got[3] == "nineteen characters\ntwenty characters no" and got[4] == "nineteen character\ntwenty characters n"


def test_query_takes_short_lines(spark, tmp_path):
    spark.createDataFrame([(1, "short\nnew"), (2, "Short\nother")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r.doc_id, r.removed) for r in op1_line_dedup(spark, str(tmp_path)).collect()} == {(1, ""), (2, "0")}


def test_lines_that_end_alike(spark):
    # nine words apart, so not near, but alike in every segment of the tail
    docs = [(n, " ".join([f"head{n}x{i}" for i in range(9)] + ["o"] * 181)) for n in range(6)]
    docs.append((6, " ".join([f"head0x{i}" for i in range(8)] + ["other"] + ["o"] * 181)))
    assert [t != "" for _, t in sorted(check(spark, docs).items())] == [True] * 6 + [False]


def test_met_once(spark):
    rows = [(h, seg, 5, own, h) for h in (1, 2, 3) for seg, own in ((10, True), (20, False), (30, True))] + [(4, 20, 5, True, 4), (4, 40, 5, True, 4)]
    df = spark.createDataFrame(rows, "h long, seg long, band int, own boolean, first long").withColumn("sign", F.lit(0))
    got = line_dedup._met_once(df, df, lambda x: x.where("first > first2"))
    assert sorted(map(tuple, got.collect())) == [(2, 1, 5), (3, 1, 5), (3, 2, 5), (4, 1, 5), (4, 2, 5), (4, 3, 5)]

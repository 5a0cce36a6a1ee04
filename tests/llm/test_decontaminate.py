import re

from spectraweave.llm import decontaminate
from spectraweave.llm.queries import op7_decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def by_hand(text, items, window=10):
    w, hit, met = words(text), set(), set()
    for item, t in items:
        x = words(t)
        for part in [x[i : i + window] for i in range(max(1, len(x) - window + 1))] if x else []:
            for at in range(len(w) - len(part) + 1):
                if w[at : at + len(part)] == part:
                    hit |= set(range(at, at + len(part)))
                    met.add(item)
    return len(w), len(hit), sorted(x for x in met if x is not None)


def rows(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {}
    for i, t in items:
        x = words(t)
        for k in range(max(1, len(x) - 9)):
            grams.setdefault(tuple(x[k : k + 10]), set()).add(i)
    got = {r.doc_id: r for r in op7_decontaminate(spark, sf).collect()}
    found = 0
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w, hit, met = words(r.text), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if tuple(w[k : k + n]) in grams and k + n <= len(w):
                    hit |= set(range(k, k + n))
                    met |= grams[tuple(w[k : k + n])]
        assert (got[r.doc_id].n_words, got[r.doc_id].n_hit, got[r.doc_id].n_items) == (len(w), len(hit), len(met))
        found += bool(hit)
    assert found


def test_edges(spark, monkeypatch):
    ten = "One two-three FOUR five six seven eight nine ten eleven twelve"
    items = [(1, ten), (2, "kurz Übung"), (3, None), (4, "..."), (None, "ohne nummer hier"), (2, "kurz Übung"), (5, "solo")]
    texts = [ten, "x one two three four five six seven eight nine ten y", "kurz übung kurz Übung", "a kurz", "kurz", None, "", ten + " " + ten, "Solo, ohne Nummer hier!", "eight nine ten"]
    docs = [(k if k != 3 else None, t) for k, t in enumerate(texts)] + [(0, ten)]
    docs.append((77, " ".join(f"q{i % 50}" for i in range(30_000)) + " kurz Übung"))
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, doc_id int")
    want = sorted(((d, *by_hand(t, items)) for d, t in docs), key=str)
    assert rows(decontaminate.matches(df, bench)) == want
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 5)
    assert rows(decontaminate.matches(df, bench)) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    assert rows(decontaminate.matches(df, bench)) == want
    assert rows(decontaminate.matches(df.limit(0), bench)) == []
    assert all(r[2] == 0 for r in rows(decontaminate.matches(df, bench.limit(0))))
    kept = decontaminate.decontaminated(df, bench)
    assert kept.columns == df.columns and {r.text for r in kept.collect()} == {t for d, t in docs if not by_hand(t, items)[1]}


def test_longest_match_and_its_place(spark):
    item = " ".join(f"w{i}" for i in range(40))
    text = "a b " + " ".join(f"w{i}" for i in range(5, 30)) + " c"
    (r,) = decontaminate.matches(
        spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(9, item)], "item_id long, text string")
    ).collect()
    assert [tuple(s) for s in r.spans] == [(2, 27, 9, 5)] and r.n_hit == 25

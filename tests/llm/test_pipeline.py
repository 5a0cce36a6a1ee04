import corpus_pipeline
from spectraweave.llm import decontaminate, simhash


def test_stages_by_their_own_inputs(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], sf)
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
        if name != "mixture":
            assert out.dtypes == docs.dtypes
    start, lang, lines, near, clean, mixed = (d.collect() for d in seen)
    assert len(lang) == sum(any(map(str.isalpha, r.text or "")) for r in start)
    before = {r.doc_id: r.text for r in lang}
    assert all(set(r.text.split("\n")) <= set(before[r.doc_id].split("\n")) for r in lines)
    prints = {r.doc_id: r.component_id for r in simhash.near_duplicates(seen[2]).collect()}
    assert sorted(r.doc_id for r in near) == sorted(set(prints.values()))
    hit = {r.doc_id for r in decontaminate.matches(seen[3], spark.read.parquet(f"{sf}/benchmark.parquet")).collect() if r.n_hit}
    assert hit and {r.doc_id for r in clean} == {r.doc_id for r in near} - hit
    assert mixed and all(r.copies in (1, 2) for r in mixed) and {r.doc_id for r in mixed} <= {r.doc_id for r in clean}
    taken, size = sum(r.copies * r.n_words for r in mixed), sum(len(r.text.split()) for r in clean)
    assert abs(taken - 1.5 * size) < 0.1 * size
    again = {(r.doc_id, r.copies) for r in corpus_pipeline.run(spark, sf).collect()}
    assert again == {(r.doc_id, r.copies) for r in mixed}


def test_odd_rows(spark, sf):
    rows = [(None, "a line without an id, but with words", None, None, None), (1, None, "en", None, 3), (2, "", "en", "s", 0), (3, "the one and only text of this", "en", None, 1), (3, "the one and only text of this", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    got = docs.collect()
    assert {r.doc_id for r in got} <= {None, 3} and len([r for r in got if r.doc_id == 3]) <= 1
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_clashing_columns(spark, sf):
    names = ["lang_pred", "score", "margin", "n_words", "copies", "source_target", "removed", "__gone", "__n", "__id", "__tag", "__document", "held_out"]
    text = "one two three four five six seven eight nine ten eleven"
    rows = [(k, f"{text} {k} {'abcdefgh'[k]} and other words", "en", "s", 60, *["x"] * len(names)) for k in range(6)]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *[f"`{c}` string" for c in names]]))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() >= 0
        if name != "mixture":
            assert docs.where("score = 'x' and n_words = 'x'").count() == docs.count()
    assert len(set(docs.columns)) == len(docs.columns) and dict(docs.dtypes)["copies"] == "int"

import duckdb
import pytest

from spectraweave.llm import quality_rules as qr
from spectraweave.llm.queries import RULES_SQL, op13_quality_rules

LONG = " ".join(f"word{k} is new" for k in range(400))


def brute(text):
    """The measures that windows decide, by comparing all windows with each other."""
    words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    hit = {k + d for k, x in enumerate(windows) for j, y in enumerate(windows) if j != k and x == y for d in range(3)}
    return len(words), sum(map(len, words)), len(hit)


@pytest.mark.parametrize("text", [None, "", " \n\t", "a", "a b", "a b c a b c", "a a a a", "é ü\nx x", "a b c d a b c a b c d", LONG[:900]])
def test_measures_equal_brute_force(text):
    got = dict(zip(qr.MEASURES, qr.measured(text)))
    assert (got["n_words"], got["word_chars"], got["n_repeat_words"]) == brute(text)


def test_measures_by_hand():
    got = dict(zip(qr.MEASURES, qr.measured("AB| x#\nAB| x#\n \nÜb 12 C.\u00a0")))
    assert got == {"n_words": 7, "word_chars": 17, "n_symbols": 4, "n_lines": 3, "n_dup_lines": 1, "n_repeat_words": 0, "n_letter_words": 6, "n_capital_words": 3}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(1, "a", LONG, 5), (1, "a", LONG, 5), (2, "a", None, None), (3, "b", "", 1), (4, "b", "x y z " * 60, 2), (5, None, " ".join(f"W{k}#" for k in range(80)), 3)]
    return qr.ledger(spark.createDataFrame(rows, "doc_id long, source string, text string, n_words int"))


def test_ledger_edges(spark, found):
    got = found.collect()
    assert found.columns == ["doc_id", "source", "text", *qr.MEASURES, "failures"] and len(got) == 6
    by = {r.doc_id: r for r in got}
    few, rep = qr.mask("few_words"), qr.mask("repeated_windows")
    assert (by[1].failures, by[2].failures, by[3].failures) == (0, few, few)
    assert by[4].failures & (few | rep) == rep and by[4].n_repeat_words == 180
    assert by[5].failures == qr.mask("many_symbols", "capitals")
    empty = qr.ledger(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and qr.ablation(empty, qr.POLICIES[1]).count() == 2


def test_policies_and_ablation(found):
    kept = {v: sorted(r.doc_id for r in found.where(p.kept(found.failures)).collect()) for v, p in qr.POLICIES.items()}
    assert kept == {1: [1, 1, 5], 2: [1, 1], 3: [1, 1]}
    got = {r.rule: (r.failed, r.dropped, r.regained) for r in qr.ablation(found, qr.POLICIES[2]).collect()}
    # against leaving each rule out of the rows themselves
    rows = [r.failures for r in found.collect()]
    policy = qr.POLICIES[2]

    def keeps(bits):
        return not bits & qr.mask(*policy.fatal) and (bits & qr.mask(*policy.others)).bit_count() <= policy.allowed

    for name in (*policy.fatal, *policy.others):
        bad = [b for b in rows if b & qr.mask(name)]
        lost = [b for b in bad if not keeps(b)]
        assert got[name] == (len(bad), len(lost), sum(keeps(b & ~qr.mask(name)) for b in lost))
    groups = {r.source: (r.rows, r.failed_by_any, r.failed_by_all) for r in qr.by_group(found, "source").collect()}
    assert groups["a"] == (3, qr.mask("few_words"), 0)


def test_matches_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got, want = op13_quality_rules(spark, sf), con.sql(RULES_SQL)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_labelled_junk_goes_and_the_rest_stays(spark):
    folder = "/root/testdata/sf0.01"
    got = op13_quality_rules(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert all(r.kept == bool(r.quality) for r in got) and len(got) > 100

"""Queries of the training-data operators, over the whole of their tables, and SQL for those that have it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, conversations, decontaminate, html_extract, langid, line_dedup, mixing, periodic, pii, quality, quality_rules, simhash, url_filter
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.size(F.split("text", "\n", -1)).alias("n_lines"))
    out = line_dedup.deduplicated(docs, removed_col="removed", **line_dedup.WHOLE)
    return out.select(
        "doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed"), F.length("text").alias("n_chars_kept"), F.md5("text").alias("text_md5")
    )


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = mixing.mix(docs, F.array("source"), mixing.word_count(F.col("text")))
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model, extra=(F.coalesce(held_out, F.lit(False)).alias("held_out"),))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    machine = quality.fit(docs.where(~held_out), table(spark, sf_dir, "labels"), metadata=F.col("n_chars"))
    out = quality.score(docs, machine, metadata=F.col("n_chars"), extra=(F.coalesce(held_out, F.lit(False)).alias("held_out"),))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.spectraweave.pseudonym.key", "a key for trying it out")
    out = pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), key, found_col="found")
    kinds = F.transform("found", lambda x: x["kind"])
    count = lambda kind: F.size(F.filter(kinds, lambda x: x == F.lit(kind))).cast("long").alias(f"n_{kind}")  # noqa: E731
    return out.select("doc_id", "text", *[count(k) for k in pii.PATTERNS])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["end"] - s["start"])), F.lit(0)).alias("longest"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where(F.col("vec_id") % 50 == 0))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))  # noqa: E731
    turns = table(spark, sf_dir, "conversations").withColumn("fault", F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20)
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    damaged = turns.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(space("role")).alias("role"), text.alias("text"), "fault", F.explode(times).alias("copy"))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = conversations.repair(damaged, present=F.col("fault") != 0)
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(number / 10)

    def looped(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        again = F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int"))))
        return F.when(n > 0, F.array_join(again, " ")).otherwise("")

    # a lambda's variable holds the words, so that a text is split once
    words = F.array(F.regexp_extract_all("text", F.lit(periodic.WORD), F.lit(0)))
    text = F.when((number % 10 == 0) & F.col("text").isNotNull(), F.get(F.transform(words, looped), F.lit(0))).otherwise(F.col("text"))
    found = periodic.with_runs(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    long = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("top", long).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, full = quality_rules.POLICIES[1], quality_rules.POLICIES[2]
    bits = F.col("failures")
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~base.kept(bits)).alias("base_failed"), (base.kept(bits) & full.kept(bits)).alias("kept"), "failures",
    )  # fmt: skip


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


MIX_SQL = r"""WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5('7:' || doc_id) AS turn FROM documents),
s AS (SELECT source, sum(size) AS n FROM d GROUP BY 1),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS w FROM s),
o AS (SELECT *, row_number() OVER v AS r, (SELECT 1.5 * sum(n) FROM s) - coalesce(sum(2 * n) OVER (v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (v ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS pool FROM w WINDOW v AS (ORDER BY 2.0 * n / w, source IS NULL, source)),
l AS (SELECT arg_min(rest / pool, r) FILTER (2.0 * n / w > rest / pool) AS share FROM o),
t AS (SELECT source, n, least(2.0 * n, coalesce(w * share, 2.0 * n)) AS target FROM w, l),
c AS (SELECT d.*, n, target, CASE WHEN n > 0 THEN least(2, floor(target / n)) ELSE 0 END AS whole, sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id ROWS UNBOUNDED PRECEDING) AS upto
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, round(target, 6) AS target, CAST(size * least(2, whole + (upto - size / 2.0 <= target - whole * n)::INT) AS BIGINT) AS taken FROM c"""

WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
LEAKS_SQL = f"""WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE len({WORDS}) > 0),
g AS (SELECT item_id, p, least(10, len(w)) AS n, array_to_string(w[p : p + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b)),
e AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT DISTINCT e.doc_id, e.p, e.n, g.item_id, e.p - g.p AS line FROM e JOIN g USING (n, g)),
k AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1),
m AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, count(*) + n - 1 AS c FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, line, n ORDER BY p) AS isle FROM h) GROUP BY doc_id, item_id, line, n, isle) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
CAST(coalesce(longest, 0) AS INT) AS longest FROM d LEFT JOIN k USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _crc_sql(text: str) -> str:
    """CRC-32 of a text of ASCII characters, by half bytes. The table follows from the polynomial."""
    table_ = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        table_.append(k)
    halves = f"flatten(list_transform(str_split({text}, ''), lambda x: [ascii(x)::BIGINT & 15, ascii(x)::BIGINT >> 4]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {halves}), lambda c, x: xor((CAST({table_} AS BIGINT[]))[1 + (xor(c, x) & 15)], c >> 4)), 4294967295)"


TURNS_SQL = rf"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range((f <> 0)::INT + (f = 3)::INT)) AS copy FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS solid FROM d),
t AS (SELECT *, solid = '' AS blank, solid <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate FROM n),
r AS (SELECT *, NOT blank AND NOT duplicate AND NOT regexp_matches(solid, '[.!?]') AS truncated, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) || role[1] AS pair FROM t),
-- what a role leads to from each state of the output: b nothing yet, s, u, a; and the role that is due there
g(st, initial, nxt, due) AS (VALUES ('b', 's', 's', false), ('b', 'u', 'u', true), ('s', 'u', 'u', true), ('u', 'a', 'a', true), ('a', 'u', 'u', true)),
-- two insertions in a row can always be left out, or a deletion is cheaper
w AS (SELECT conv_id, 0 AS i, 'b' AS st, {{'cost': 0::BIGINT, 'audit': '', 'text': []::VARCHAR[]}} AS best FROM (SELECT DISTINCT conv_id FROM r)
    UNION ALL (
    WITH o AS (SELECT conv_id, i, st, best FROM w UNION ALL
        SELECT conv_id, i, nxt, {{'cost': best.cost + 2, 'audit': best.audit || 'I', 'text': list_append(best.text, CASE initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END)}} FROM w JOIN g USING (st) WHERE due),
    e AS (SELECT o.conv_id, o.i + 1 AS i, o.st, o.best, r.role, r.text, r.blank OR r.duplicate AS forced, r.truncated::BIGINT AS extra FROM o JOIN r ON o.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = o.i + 1),
    x AS (SELECT conv_id, i, st, {{'cost': best.cost + 3, 'audit': best.audit || 'D', 'text': best.text}} AS best FROM e UNION ALL
        SELECT conv_id, i, nxt, {{'cost': best.cost + extra, 'audit': best.audit || 'K', 'text': list_append(best.text, role || ':' || text)}} FROM e JOIN g ON e.st = g.st AND e.role[1] = g.initial WHERE NOT forced UNION ALL
        SELECT conv_id, i, nxt, {{'cost': best.cost + extra + 2, 'audit': best.audit || 'R', 'text': list_append(best.text, CASE initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text)}} FROM e JOIN g ON e.st = g.st AND due WHERE NOT forced)
    SELECT conv_id, i, st, min(best) FROM x GROUP BY ALL)),
s AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
    count(*) FILTER (truncated) AS truncated, count(*) FILTER (i > 1 AND coalesce(pair NOT IN ('su', 'ua', 'au'), true)) AS illegal, max(i) AS n FROM r GROUP BY conv_id),
z AS (SELECT s.conv_id, CASE WHEN w.st IN ('b', 'a') THEN best
    ELSE {{'cost': best.cost + 2, 'audit': best.audit || 'I', 'text': list_append(best.text, 'assistant:')}} END AS best FROM w JOIN s ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.i = s.n WHERE w.st <> 's'),
y AS (SELECT conv_id, min(best) AS best FROM z GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.text, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN s ON k.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN y ON k.conv_id IS NOT DISTINCT FROM y.conv_id"""

RUNS_SQL = rf"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^ 	-]+'), []) AS w, {_crc_sql("doc_id::VARCHAR")} AS h FROM documents),
e AS (SELECT *, len(w) AS n, (h // 10) % greatest(len(w), 1) AS a, h // 10 AS g FROM d),
t AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))] END) ELSE w END AS w FROM e),
f AS (SELECT doc_id, n, i, array_to_string(w[i + 1 : i + 5], ' ') AS five FROM (SELECT doc_id, n, w, unnest(range(n - 4)) AS i FROM t)),
-- a run holds the same five words one period apart
q AS (SELECT DISTINCT x.doc_id, y.i - x.i AS q FROM f x JOIN f y ON x.doc_id = y.doc_id AND x.five = y.five AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
m AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM (SELECT q.doc_id, q, w, unnest(range(n - q)) AS i FROM q JOIN t USING (doc_id)) WHERE w[i + 1] = w[i + q + 1]),
s AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM m GROUP BY doc_id, q, isle HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS q FROM s GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'q': q}}, [-length, start, q]) AS top, sha256(string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q)) AS runs_sha256 FROM r GROUP BY 1),
x AS (SELECT DISTINCT doc_id, unnest(range(start + q, start + length)) AS i FROM r),
k AS (SELECT doc_id, sha256(string_agg(v, ' ' ORDER BY i)) AS collapsed_sha256 FROM (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS v FROM t) ANTI JOIN x USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.q AS period, 1000 * top.length // top.q AS exponent_milli,
coalesce(runs_sha256, sha256('')) AS runs_sha256, coalesce(collapsed_sha256, sha256('')) AS collapsed_sha256 FROM t LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)"""

RULES_SQL = r"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(str_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{Lu}') AND NOT regexp_matches(x, '\p{Ll}'))) AS n_capital_words FROM t),
p AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, w[p], w[p + 1], w[p + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM l)),
c AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM p WHERE n > 1) GROUP BY 1),
m AS (SELECT l.*, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words FROM l LEFT JOIN c USING (doc_id)),
f AS (SELECT *, (n_words < 50)::BIGINT AS few, (100 * n_repeat_words > 50 * n_words)::BIGINT AS windows, (100 * n_symbols > 10 * n_words)::BIGINT AS symbols,
    (100 * n_dup_lines > 50 * len(lines))::BIGINT AS dup, (word_chars < 2 * n_words)::BIGINT AS short, (word_chars > 20 * n_words)::BIGINT AS long,
    (100 * n_letter_words < 70 * n_words)::BIGINT AS letters, (100 * n_capital_words > 30 * n_words)::BIGINT AS capitals FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, few + windows > 0 AS base_failed,
few + windows + symbols + letters + capitals = 0 AND dup + short + long <= 1 AS kept,
few + 2 * windows + 4 * symbols + 8 * dup + 16 * short + 32 * long + 64 * letters + 128 * capitals AS failures FROM f"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same; the others are tested against brute force, round trips or held-out rows."""
    return {"op2_mix_sources": MIX_SQL, "op7_decontaminate": LEAKS_SQL, "op11_conversations": TURNS_SQL, "op12_periodic_runs": RUNS_SQL, "op13_quality_rules": RULES_SQL}

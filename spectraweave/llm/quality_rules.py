"""Quality rules as a ledger: every rule is evaluated once, policies and ablations are bitwise operations on what it found.

`ledger` measures each text and stores, beside the measurements, one bit per rule
that the text fails. A policy is a versioned mask of those bits, so that another
policy, or the effect of leaving a rule out, needs no second look at any text.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, with_columns_from

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"

#: What `measured` finds in a text, in order; all are counts.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letter_words", "n_capital_words")


@dataclass(frozen=True)
class Rule:
    """A rule fails if this SQL condition on the measurements holds; its bit is its place in RULES, so new rules go to the end."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("few_letters", "100 * n_letter_words < 70 * n_words"),
    Rule("capitals", "100 * n_capital_words > 30 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A text goes if it fails any fatal rule, or more than `allowed` of the others."""

    fatal: tuple[str, ...]
    others: tuple[str, ...] = ()
    allowed: int = 0

    def kept(self, failures: Column) -> Column:
        fatal, others = F.lit(mask(*self.fatal)), F.lit(mask(*self.others))
        return (failures.bitwiseAND(fatal) == 0) & (F.bit_count(failures.bitwiseAND(others)) <= self.allowed)


#: By version. A version is never changed, only followed by another.
POLICIES = {
    1: Policy(("few_words", "repeated_windows")),
    2: Policy(("few_words", "repeated_windows", "many_symbols", "few_letters", "capitals"), ("repeated_lines", "short_words", "long_words"), 1),
    3: Policy(tuple(r.name for r in RULES)),
}


def mask(*names: str) -> int:
    """The bits of the named rules."""
    place = {r.name: k for k, r in enumerate(RULES)}
    return sum(1 << place[n] for n in set(names))


def measured(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a whole text; a null text has none of anything."""
    text = text or ""
    words = _WORD.findall(text)
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(found := set(windows)) < len(windows):
        counts = Counter(windows)
        twice = np.fromiter((counts[x] > 1 for x in windows), bool, n - 2)
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeated = int(covered.sum())
        counts.clear()
    found.clear()
    return (
        n,
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated,
        sum(w[0].isalpha() or any(map(str.isalpha, w)) for w in words),
        sum(map(str.isupper, words)),
    )


def ledger(docs: DataFrame, text_col: str = "text", failures_col: str = "failures") -> DataFrame:
    """docs with the MEASURES of each whole text (long) and `failures`, a long with the bits of the RULES that it fails.

    Columns of docs of these names are replaced. Null and empty texts have zero of
    everything and fail `few_words`. Equal rows give equal rows; an empty table
    gives none. A very long text takes time and memory in proportion.
    """
    def find(texts: list) -> dict[str, pa.Array]:
        rows = [measured(t) for t in texts]
        return {m: pa.array([r[k] for r in rows], pa.int64()) for k, m in enumerate(MEASURES)}

    hidden = unused(docs, "__whole")
    texts = docs.withColumn(hidden, F.col(text_col).cast("string"))
    held = with_columns_from(texts, hidden, find, ", ".join(f"{m} long" for m in MEASURES), drop=True)
    bits = [F.when(F.expr(r.fails), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, r in enumerate(RULES)]
    failures = bits[0]
    for b in bits[1:]:
        failures = failures.bitwiseOR(b)
    return held.withColumn(failures_col, failures)


def ablation(found: DataFrame, policy: Policy, failures_col: str = "failures") -> DataFrame:
    """(rule, failed, dropped, regained) for each rule of the policy.

    failed: rows that fail the rule; dropped: those of them that the policy drops;
    regained: those it would keep if the rule were left out. Rows are first
    counted by pattern of bits, of which there are at most 2 ** len(RULES), however
    many rows there are. An empty ledger gives zeros.
    """
    spark = found.sparkSession
    rules = [(n, mask(n)) for n in (*policy.fatal, *policy.others)]
    patterns = found.groupBy(F.col(failures_col).cast("long").alias("__f")).agg(F.count("*").alias("__n"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(m).cast("long").alias("bit")) for n, m in rules]))
    failing = patterns.select("__f", "__n", each.alias("r")).select("__f", "__n", "r.*").where(F.col("__f").bitwiseAND(F.col("bit")) != 0)
    without = policy.kept(F.col("__f").bitwiseAND(F.bitwise_not("bit")))
    counted = failing.groupBy("rule").agg(
        F.sum("__n").alias("failed"),
        F.sum(F.when(~policy.kept(F.col("__f")), F.col("__n")).otherwise(0)).alias("dropped"),
        F.sum(F.when(~policy.kept(F.col("__f")) & without, F.col("__n")).otherwise(0)).alias("regained"),
    )
    names = spark.createDataFrame(rules, "rule string, bit long").select("rule")
    return names.join(counted, "rule", "left").select("rule", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("failed", "dropped", "regained")])


def by_group(found: DataFrame, *keys: str, failures_col: str = "failures") -> DataFrame:
    """(keys, rows, failed_by_any, failed_by_all): the bits that some row, and that every row, of a group fails."""
    return found.groupBy(*keys).agg(F.count("*").alias("rows"), F.bit_or(failures_col).alias("failed_by_any"), F.bit_and(failures_col).alias("failed_by_all"))

"""URL filters: rules first, then naive Bayes over segmented host and path words.

Names run together in hosts are split into words by a unigram Viterbi search
over a public vocabulary. A multinomial naive Bayes model judges the words. It
starts from a fixed list of words that mark unwanted hosts: hosts with one of
them are blocked, all others allowed, and the words of both are counted over all
pages, each once a host. Expectation-maximisation then goes on from there: the
other hosts count for both classes by what the model says of them, so that words
that come with the marks, of hosts and of paths, are learned.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
# Words that mark unwanted hosts.
MARKS = frozenset(
    "adserver adult ads advert adverts advertising adware bet bets betting bingo blackjack botnet cams casino casinos cialis clickbait "
    "crack cracked dating doorway drugs erotic escort escorts gamble gambling hookup jackpot keygen loan loans lottery malware meds nude "
    "nudes payday pharma pharmacy phishing pills poker popunder porn porno replica roulette scam sex slots spam spammer spyware torrent "
    "tracker viagra virus warez webcam xxx".split()
)
#: Share of the marks in the blocked class's words, and the weight, in words, of the pooled share of a word in each class.
MARK_SHARE, POOLED = 0.3, 100.0
#: Log-odds of the blocked class: fixed, as the share of marked hosts must not decide.
PRIOR = math.log(0.15 / 0.85)
#: Rounds of expectation-maximisation, and the weight of the hosts without a mark in the blocked class.
ROUNDS, UNMARKED = 3, 0.5
_RUN = re.compile(r"[a-z]+")


@lru_cache(2)
def lexicon(path: str) -> dict[str, float]:
    """Log-probability by word: the vocabulary's whole words, by rank, as in Zipf's law."""
    with open(path, encoding="utf-8") as f:
        ranks = json.load(f)["model"]["vocab"]
    found = sorted((r, w[:-4]) for w, r in ranks.items() if w.endswith("</w>") and re.fullmatch("[a-z]{2,24}", w[:-4]))
    words = {w: 1 / (k + 10) for k, (_, w) in enumerate(found)} | {c: 1e-6 for c in "aix"}
    words |= {w: max(words.get(w, 0), 1e-4) for w in MARKS}
    total = sum(words.values())
    return {w: math.log(x / total) for w, x in words.items()}


def segment(run: str, words: dict[str, float]) -> list[str]:
    """The likeliest split of a run of letters; letters in no word stay together."""
    best, back = [0.0] * (len(run) + 1), [0] * (len(run) + 1)
    for end in range(1, len(run) + 1):
        best[end], back[end] = best[end - 1] - 16.0, end - 1
        for start in range(max(0, end - 24), end):
            p = words.get(run[start:end])
            if p is not None and best[start] + p > best[end]:
                best[end], back[end] = best[start] + p, start
    parts, end = [], len(run)
    while end:
        parts.append(run[back[end] : end])
        end = back[end]
    out: list[str] = []
    for x in reversed(parts):
        if x not in words and out and out[-1] not in words:
            out[-1] += x
        else:
            out.append(x)
    return out


def tokens(host: str, path: str, words: dict[str, float], seen: dict[str, list[str]]) -> list[str]:
    out = []
    for kind, text in (("h:", host), ("p:", path)):
        for run in _RUN.findall(text.lower()):
            if run not in seen:
                seen[run] = segment(run, words)
            out += [kind + (w if w in words else "?") for w in seen[run]]
    return out


def learn(pairs: DataFrame, marks: frozenset[str], rounds: int = ROUNDS) -> tuple[dict[str, float], float]:
    """Log-odds of the words of pairs (host, token), each pair once, learned in rounds from the marked hosts.

    A table of words, no larger than twice the vocabulary, comes to the driver and
    is sent out again in each round; hosts stay where they are.
    """
    marked = F.max(F.col("token").isin([f"h:{w}" for w in marks])).over(Window.partitionBy("host"))
    known = checkpointed(pairs.withColumn("marked", marked))
    share = known.withColumn("b", F.col("marked").cast("double"))
    while True:
        sums = share.groupBy("token").agg(F.round(F.sum("b"), 6).alias("b"), F.round(F.sum(1 - F.col("b")), 6).alias("a")).collect()
        odds, unseen = weigh({(r.token, c): n for r in sums for c, n in ((True, r.b), (False, r.a)) if n}, marks)
        if rounds == 0 or not odds:
            return odds, unseen
        rounds -= 1
        words = known.sparkSession.createDataFrame(list(odds.items()), "token string, odds double")
        total = F.coalesce(F.sum("odds").over(Window.partitionBy("host")), F.lit(0.0)) + PRIOR
        chance = UNMARKED / (1 + F.exp(-F.least(F.greatest(total, F.lit(-50.0)), F.lit(50.0))))
        share = known.join(F.broadcast(words), "token", "left").withColumn("b", F.when(F.col("marked"), 1.0).otherwise(chance))


def weigh(counts: dict[tuple[str, bool], float], marks: frozenset[str]) -> tuple[dict[str, float], float]:
    """Log-odds of blocked to allowed for each word, and for a word not met."""
    met = {t for t, _ in counts} | {f"h:{w}" for w in marks}
    total = {c: sum(n for (_, b), n in counts.items() if b == c) for c in (True, False)}
    size = sum(total.values()) + len(met) + 1

    def share(t: str, c: bool) -> float:
        mark = t[:2] == "h:" and t[2:] in marks
        # what the marked hosts have of a mark says nothing of allowed ones
        pooled = (0.02 if mark else counts.get((t, True), 0) + counts.get((t, False), 0) + 1) / size
        own = (counts.get((t, c), 0) + POOLED * pooled) / (total[c] + POOLED)
        return own if not c else (1 - MARK_SHARE) * own + MARK_SHARE * mark / max(1, len(marks))

    return {t: math.log(share(t, True)) - math.log(share(t, False)) for t in met}, math.log(share("", True)) - math.log(share("", False))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path without query and fragment; both empty without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_for(host: str, path: str, rules: dict[str, list[tuple[str, str, str]]]) -> tuple[str, str] | None:
    """The longest rule (rule, verdict) whose host is the host or a parent of it and whose path starts the path."""
    found, rest = [], host
    while True:
        found += [(len(rule), rule, verdict) for start, rule, verdict in rules.get(rest, ()) if path.startswith(start)]
        if "." not in rest:
            return max(found)[1:] if found else None
        rest = rest.partition(".")[2]


def judge(
    pages: DataFrame,
    rules: list[tuple[str, str]] = (),
    id_col: str = "page_id",
    url_col: str = "url",
    vocabulary: str = VOCABULARY,
    marks: frozenset[str] = MARKS,
    rounds: int = ROUNDS,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_probability) for each page.

    rules: (`host/path`, allow or block); a rule holds for its host and all
    subdomains if the path starts with the rule's, and the longest wins. Without
    a rule the model's verdict is given. A null url, or one without `://`, has an
    empty host and path and is allowed. Long hosts and paths are judged whole. Words are counted once for each host, so
    a host with many pages weighs as any other, and the table of counts is no
    larger than twice the vocabulary. Equal rows give equal rows; an empty table
    gives none.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen = lexicon(vocabulary), {}
        for b in batches:
            if len(seen) > 200_000:
                seen.clear()
            found = {(h, t) for h, p in zip(b["host"], b["path"]) for t in tokens(h, p, words, seen)}
            yield pd.DataFrame(sorted(found), columns=["host", "token"])

    pairs = rows.where("host <> ''").select("host", "path").distinct().mapInPandas(split, "host string, token string").distinct()
    log_odds, unseen = learn(pairs, marks, rounds)
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for rule, verdict in rules:
        at, slash, start = rule.partition("/")
        by_host.setdefault(at, []).append((slash + start, rule, verdict))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, seen = lexicon(vocabulary), {}
        for b in batches:
            if len(seen) > 200_000:
                seen.clear()
            out = []
            for h, p in zip(b["host"], b["path"]):
                odds = PRIOR + sum(log_odds.get(t, unseen) for t in tokens(h, p, words, seen)) if h else -50.0
                chance = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
                rule, verdict = rule_for(h, p, by_host) or (None, "block" if chance > 0.5 else "allow")
                out.append((rule, verdict, chance))
            b[["rule", "verdict", "block_probability"]] = pd.DataFrame(out, columns=["r", "v", "c"], index=b.index)
            yield b

    return rows.mapInPandas(run, "page_id long, host string, path string, rule string, verdict string, block_probability double")

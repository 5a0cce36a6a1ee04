"""Language identification by unigram pieces, summed over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A
word's probability is the sum over all of its splits into pieces, found with the
forward algorithm; a text's is the product over its words. The probabilities are
learned by expectation-maximisation, with the forward-backward algorithm, from
word counts of a bounded sample of labelled texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Labelled texts of a language that the model is fitted on, about; chosen by hash of text.
TRAIN_TEXTS = 1_500
ROUNDS = 3
MAX_LANGUAGES = 200
#: Longest word, in letters, that is learned from; longer ones are scored like any other.
TRAIN_WORD = 64
_LETTERS = re.compile(r"[^\W\d_]+")
#: Words that are segmented at once, texts that are looked at together, and words whose scores a worker keeps.
_BLOCK, _TEXTS, _WORDS = 20_000, 500, 300_000
#: Characters of such words, and places after which probabilities are scaled again.
_CHARS, _SCALED = 1_000_000, 16
#: Share of the pooled probabilities in each language's, and of a character outside the vocabulary.
POOLED, UNKNOWN = 0.02, 1e-7


class Pieces:
    """The vocabulary as a trie: a node per prefix, looked up by (node, character) in sorted keys."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
        self.pieces = sorted({p.lower() for p in found if re.fullmatch(r"▁?[^\W\d_]+|▁", p)})
        self.longest = max(map(len, self.pieces))
        nodes, ends = {"": 0}, {}
        for k, p in enumerate(self.pieces):
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
            ends[nodes[p]] = k
        keys = sorted((nodes[p[:-1]] << 21 | ord(p[-1]), n) for p, n in nodes.items() if p)
        self.keys, self.next = np.array([k for k, _ in keys]), np.array([n for _, n in keys])
        self.piece = np.full(len(nodes), -1)
        self.piece[list(ends)] = list(ends.values())

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        key = node << 21 | char
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.next[at], -1)

    def edges(self, chars: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of all places of pieces in the words, by start."""
        for start in range(chars.shape[1]):
            rows = np.nonzero(lengths > start)[0]
            node = np.zeros(len(rows), np.int64)
            for end in range(start + 1, min(start + self.longest, chars.shape[1]) + 1):
                node = self.step(node, chars[rows, end - 1])
                live = (node >= 0) & (lengths[rows] >= end)
                rows, node = rows[live], node[live]
                if not len(rows):
                    break
                piece = self.piece[node]
                is_piece = piece >= 0
                if is_piece.any():
                    yield start, end, rows[is_piece], piece[is_piece]


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the marked words, padded with 0, and lengths."""
    lengths = np.array([len(w) + 1 for w in words])
    chars = np.zeros((len(words), lengths.max()), np.int64)
    flat = np.frombuffer("".join("▁" + w for w in words).encode("utf-32-le"), "<u4")
    chars[np.arange(chars.shape[1])[None, :] < lengths[:, None]] = flat
    return chars, lengths


def _blocks(words: list[str]) -> Iterator[list[int]]:
    """The words' numbers, by length, in blocks of a bounded number of characters (one word at least)."""
    block: list[int] = []
    for k in sorted(range(len(words)), key=lambda k: len(words[k])):
        if block and (len(block) == _BLOCK or (len(block) + 1) * (len(words[k]) + 2) > _CHARS):
            yield block
            block = []
        block.append(k)
    if block:
        yield block


def forward(words: list[str], table: Pieces, chance: np.ndarray) -> np.ndarray:
    """The log-probability of each word in each language; chance: pieces x languages.

    In long words the probabilities are scaled every few places, as they would
    become too small for numbers.
    """
    out = np.zeros((len(words), chance.shape[1]))
    for some in _blocks(words):
        chars, lengths = _matrix([words[k] for k in some])
        alpha = np.zeros((chars.shape[1] + 1, len(some), chance.shape[1]))
        scale = np.zeros((len(some), chance.shape[1]))
        alpha[0] = 1
        done = 0

        def single(done: int) -> None:
            """A character can also stand alone, unknown."""
            alpha[done + 1] += alpha[done] * UNKNOWN  # noqa: B023
            if (done + 1) % _SCALED == 0:
                rows = np.nonzero(lengths > done + 1)[0]  # noqa: B023
                top = alpha[done + 1, rows]  # noqa: B023
                scale[rows] += np.log(top)  # noqa: B023
                alpha[done + 1 : done + 1 + table.longest, rows] /= top  # noqa: B023

        for start, end, rows, piece in table.edges(chars, lengths):
            while done < start:
                single(done)
                done += 1
            alpha[end, rows] += alpha[start, rows] * chance[piece]
        for done in range(done, chars.shape[1]):
            single(done)
        out[some] = np.log(alpha[lengths, np.arange(len(some))]) + scale
    return out


def expected(words: list[str], counts: np.ndarray, table: Pieces, chance: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in words with counts (words x languages), over all splits."""
    sums = np.zeros_like(chance)
    for some in _blocks(words):
        chars, lengths = _matrix([words[k] for k in some])
        edges = list(table.edges(chars, lengths))
        alpha = np.zeros((chars.shape[1] + 1, len(some), chance.shape[1]))
        beta = np.zeros_like(alpha)
        alpha[0], beta[lengths, np.arange(len(some))] = 1, 1
        done = 0
        for start, end, rows, piece in edges:
            while done < start:
                alpha[done + 1] += alpha[done] * UNKNOWN
                done += 1
            alpha[end, rows] += alpha[start, rows] * chance[piece]
        for done in range(done, chars.shape[1]):
            alpha[done + 1] += alpha[done] * UNKNOWN
        done = chars.shape[1]
        for start, end, rows, piece in reversed(edges):
            while done > start:
                done -= 1
                beta[done] += beta[done + 1] * UNKNOWN
            beta[start, rows] += beta[end, rows] * chance[piece]
        whole = alpha[lengths, np.arange(len(some))]
        share = counts[some] / np.maximum(whole, 1e-300)
        for start, end, rows, piece in edges:
            np.add.at(sums, piece, alpha[start, rows] * chance[piece] * beta[end, rows] * share[rows])
    return sums


def text_words(text: str | None) -> list[str]:
    """Lower-case runs of letters of the whole text."""
    return [w for w in _LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, sample: int = TRAIN_TEXTS) -> tuple[list[str], np.ndarray]:
    """(languages, pieces x languages probabilities) from labelled texts.

    Of a language with more texts than `sample`, about that many are used, chosen
    by a hash of the text; words of over TRAIN_WORD letters are not learned from.
    The word counts are gathered and the expectations
    summed by Spark; a table of pieces x languages comes to the driver in each round.
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")
    langs = sorted(sizes)
    table = pieces(vocabulary)
    if not langs:
        return [], np.zeros((len(table.pieces), 0))
    step = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, max(1, n // sample))])
    some = rows.where(F.pmod(F.xxhash64("text"), step[F.col("lang")]) == 0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            by: Counter = Counter()
            for t, lang in zip(b["text"], b["lang"]):
                by.update((lang, w) for w in text_words(t) if len(w) <= TRAIN_WORD)
            yield pd.DataFrame([(*k, n) for k, n in by.items()], columns=["lang", "word", "n"])

    number = {lang: k for k, lang in enumerate(langs)}
    words = some.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    chance = np.full((len(table.pieces), len(langs)), 1 / len(table.pieces))
    for _ in range(ROUNDS):
        shared = labelled.sparkSession.sparkContext.broadcast(chance)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums, known = np.zeros_like(shared.value), pieces(vocabulary)
            for b in batches:
                f = b.pivot_table(index="word", columns="lang", values="n", fill_value=0, aggfunc="sum").reindex(columns=langs, fill_value=0)
                if len(f):
                    sums += expected(list(f.index), f.to_numpy(float), known, shared.value)
            k, j = np.nonzero(sums)
            yield pd.DataFrame({"piece": k, "lang": j, "n": sums[k, j]})

        got = words.mapInPandas(expect, "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        sums = np.zeros_like(chance)
        # summed in a set order and rounded, so that reruns agree
        sums[got["piece"], got["lang"]] = got["n"].round(6)
        own = sums / np.maximum(sums.sum(axis=0), 1e-9)
        pooled = (own.sum(axis=1) + 1 / len(own)) / (len(langs) + 1)
        chance = (1 - POOLED) * own + POOLED * pooled[:, None]
    words.unpersist()
    return langs, np.round(chance, 12) + 1e-12


def identify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", extra: tuple[Column, ...] = (), id_col: str = "doc_id", vocabulary: str = VOCABULARY
) -> DataFrame:
    """(doc_id, *extra, lang_pred, score, margin) for each row, from its whole text.

    lang_pred: the likeliest language; `und`, with score 0, for a text that is
    null or has no letter, and for all texts if nothing was learned. score: the
    language's posterior probability, with equal priors. margin: by how much its
    log-probability a word exceeds the next language's. Ties go to the first
    language by code point. Equal rows give equal rows; an empty table gives none.
    """
    langs, chance = model
    shared = docs.sparkSession.sparkContext.broadcast(chance)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *extra, F.col(text_col).cast("string").alias("__text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, seen = pieces(vocabulary), {}
        scores = np.zeros((0, len(langs)))
        for b in batches:
            pred, score, margin = [], [], []
            for at in range(0, len(b), _TEXTS):
                found = [Counter(text_words(t)) for t in b["__text"].iloc[at : at + _TEXTS]]
                if len(seen) > _WORDS:
                    seen, scores = {}, scores[:0]
                new = list({w: None for c in found for w in c if w not in seen}) if langs else []
                if new:
                    seen |= dict(zip(new, range(len(seen), len(seen) + len(new))))
                    scores = np.concatenate((scores, forward(new, known, shared.value)))
                for c in found:
                    if not c or not langs:
                        pred.append("und"), score.append(0.0), margin.append(0.0)
                        continue
                    n = np.fromiter(c.values(), float, len(c))
                    total = n @ scores[[seen[w] for w in c]]
                    k = int(total.argmax())
                    pred.append(langs[k])
                    score.append(float(1 / np.exp(np.maximum(total - total[k], -700)).sum()))
                    margin.append(float((total[k] - np.delete(total, k).max()) / n.sum()) if len(langs) > 1 else 0.0)
            yield b.drop(columns="__text").assign(lang_pred=pred, score=score, margin=margin)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "__text")
    return rows.mapInPandas(run, f"{schema}, lang_pred string, score double, margin double")

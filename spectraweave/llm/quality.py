"""Quality classifier: a factorisation machine over words, structure and metadata.

A text's inputs are its hashed words, counts of its structure put in bands, and
the metadata that is given. Beside a weight each has a short vector, and each
pair of inputs adds the product of its two vectors; by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)
that takes time linear in the inputs.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that the model is fitted on, at most; chosen by hash.
TRAIN_ROWS = 8_000
WORD_BUCKETS, RANK = 1 << 13, 6
EPOCHS, STEPS, BATCH, RATE, DECAY = 12, 1_500, 64, 0.03, 1e-4  # both epochs and steps are least numbers
#: Names and band borders of what is measured of a text's structure.
BANDS = {
    "words": [0.5, 5.5, 10.5, 20.5, 50.5, 100.5, 300.5, 1000.5, 5000.5],
    "word_length": [2, 3, 4, 5, 6, 8, 12, 20],
    "upper_share": [0.01, 0.03, 0.06, 0.12, 0.3, 0.6],
    "letter_share": [0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.9, 0.97],
    "symbol_share": [0.005, 0.02, 0.04, 0.06, 0.1, 0.2, 0.4],
    "digit_share": [0.002, 0.01, 0.05, 0.2],
    "distinct_share": [0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9],
    "top_word_share": [0.02, 0.05, 0.08, 0.12, 0.2, 0.35, 0.6],
    "repeat_share": [0.01, 0.05, 0.1, 0.3, 0.6],
    "repeated_pair_share": [0.02, 0.05, 0.1, 0.2, 0.4, 0.7],
    "stop_end_share": [0.01, 0.03, 0.06, 0.1, 0.2, 0.4],
    "odd_word_share": [0.02, 0.1, 0.3, 0.6],
    "line_words": [2, 5, 10, 20, 50, 150],
    "repeated_line_share": [0.05, 0.2, 0.5],
    "metadata": [0.5, 20, 100, 500, 2000, 10_000, 50_000],
}
_STARTS = dict(zip(BANDS, np.cumsum([0, *(len(b) + 1 for b in BANDS.values())]).tolist()))
INPUTS = WORD_BUCKETS + sum(len(b) + 1 for b in BANDS.values())


def measures(text: str, words: list[str], counts: Counter) -> dict[str, float]:
    """The structure of a whole text."""
    n, chars = max(1, len(words)), max(1, len(text))
    kinds = Counter(map(_KIND, text)) if len(text) < 1 << 12 else _kinds(text)
    pairs = Counter(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "words": len(words),
        "word_length": sum(map(len, words)) / n,
        "upper_share": kinds["U"] / chars,
        "letter_share": (kinds["U"] + kinds["L"]) / chars,
        "symbol_share": kinds["S"] / chars,
        "digit_share": kinds["D"] / chars,
        "distinct_share": len(counts) / n,
        "top_word_share": max(counts.values(), default=0) / n,
        "repeat_share": sum(a == b for a, b in zip(words, words[1:])) / n,
        "repeated_pair_share": sum(c for c in pairs.values() if c > 1) / n,
        "stop_end_share": sum(w[-1] in ".!?" for w in words) / n,
        "odd_word_share": sum(not any(map(str.isalnum, w)) or not w.rstrip(".,;:!?")[-1:].isalnum() for w in words) / n,
        "line_words": len(words) / max(1, len(lines)),
        "repeated_line_share": 1 - len(set(lines)) / len(lines) if lines else 0.0,
    }


def _KIND(c: str) -> str:  # noqa: N802
    return "D" if c.isdigit() else "U" if c.isupper() else "L" if c.isalpha() else "W" if c.isspace() else "S"


def _kinds(text: str) -> Counter:
    out: Counter = Counter()
    for c, n in Counter(text).items():
        out[_KIND(c)] += n
    return out


def inputs(text: str | None, metadata: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of a text's inputs; the words' values have length 1 together."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    by: dict[int, float] = {}
    for w, n in Counter(w.lower().strip(".,;:!?") for w in counts.elements()).items():
        k = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS
        by[k] = by.get(k, 0.0) + 1 + math.log(n)
    norm = math.sqrt(sum(x * x for x in by.values())) or 1.0
    found = measures(text, words, counts) | {"metadata": metadata if metadata is not None and math.isfinite(metadata) else 0.0}
    bands = [WORD_BUCKETS + _STARTS[k] + int(np.searchsorted(BANDS[k], x, "right")) for k, x in found.items()]
    return np.array([*by, *bands], np.int32), np.array([*(x / norm for x in by.values()), *[1.0] * len(bands)], np.float32)


class Machine:
    """Weights of a factorisation machine, fitted by Adagrad on mini-batches."""

    def __init__(self) -> None:
        rng = np.random.default_rng(11)
        self.bias, self.weight = 0.0, np.zeros(INPUTS)
        self.vector = rng.normal(0, 0.01, (INPUTS, RANK))

    def raw(self, ids: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and sums of vectors, of rows that begin at `starts` in the joined inputs."""
        v = self.vector[ids] * values[:, None]
        sums = np.add.reduceat(v, starts)
        pairs = 0.5 * ((sums * sums).sum(axis=1) - np.add.reduceat((v * v).sum(axis=1), starts))
        return self.bias + np.add.reduceat(self.weight[ids] * values, starts) + pairs, sums

    def chance(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        sizes = np.array([len(i) for i, _ in rows])
        raw, _ = self.raw(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]).astype(float), np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Machine:
        rng = np.random.default_rng(12)
        g_bias, g_weight, g_vector = 1e-8, np.full(INPUTS, 1e-8), np.full((INPUTS, RANK), 1e-8)
        rate = labels.mean() if len(labels) else 0.5
        self.bias = math.log((rate + 1e-3) / (1 - rate + 1e-3))
        for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(labels))) if len(labels) else 0):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                ids, values = np.concatenate([rows[k][0] for k in some]), np.concatenate([rows[k][1] for k in some]).astype(float)
                sizes = np.array([len(rows[k][0]) for k in some])
                raw, sums = self.raw(ids, values, np.cumsum(sizes) - sizes)
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[some]) / len(some)
                e = np.repeat(error, sizes) * values
                used, place = np.unique(ids, return_inverse=True)
                d_weight = np.bincount(place, e, len(used)) + DECAY * self.weight[used]
                step = e[:, None] * (np.repeat(sums, sizes, axis=0) - self.vector[ids] * values[:, None])
                d_vector = np.stack([np.bincount(place, step[:, f], len(used)) for f in range(RANK)], axis=1) + DECAY * self.vector[used]
                g_bias += error.sum() ** 2
                self.bias -= RATE * error.sum() / math.sqrt(g_bias)
                g_weight[used] += d_weight**2
                self.weight[used] -= RATE * d_weight / np.sqrt(g_weight[used])
                g_vector[used] += d_vector**2
                self.vector[used] -= RATE * d_vector / np.sqrt(g_vector[used])
        return self


def _rows(docs: DataFrame, id_col: str, text_col: str, metadata: Column | None, extra: tuple[Column, ...] = ()) -> DataFrame:
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *extra, F.col(text_col).cast("string").alias("text"), (F.lit(None) if metadata is None else metadata).cast("double").alias("metadata")
    )


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", metadata: Column | None = None, sample: int = TRAIN_ROWS
) -> Machine:
    """A machine fitted on labelled documents, at most about `sample` of them, chosen by hash of id.

    A document with several labels counts by their mean. The inputs are made on
    the executors; only those of the bounded sample come to the driver.
    """
    known = labels.groupBy(F.col(id_col).alias("labelled")).agg(F.avg(F.col(label_col).cast("double")).alias("label")).where("labelled is not null and label is not null")
    step = max(1, -(-known.count() // sample))
    some = known.where(F.pmod(F.xxhash64("labelled"), F.lit(step)) == 0)
    rows = _rows(docs, id_col, text_col, metadata).join(some, F.col("doc_id") == F.col("labelled")).select("doc_id", "text", "metadata", "label")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [inputs(t, None if pd.isna(m) else m) for t, m in zip(b["text"], b["metadata"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [i for i, _ in found], "vals": [v for _, v in found], "label": b["label"]})

    got = rows.mapInPandas(run, "doc_id long, ids array<int>, vals array<float>, label double").toPandas().sort_values("doc_id", kind="stable")
    return Machine().fit([(np.asarray(i), np.asarray(v)) for i, v in zip(got["ids"], got["vals"])], got["label"].to_numpy(float))


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", metadata: Column | None = None, extra: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, *extra, score): for each row the chance of label 1, from its whole text.

    Null and empty texts are scored as texts without words; without any labels
    all scores are even. Equal rows give equal rows; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = _rows(docs, id_col, text_col, metadata, extra)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = []
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                found.append(shared.value.chance([inputs(t, None if pd.isna(m) else m) for t, m in zip(part["text"], part["metadata"])]))
            yield b.drop(columns=["text", "metadata"]).assign(score=np.concatenate([np.zeros(0), *found]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name not in ("text", "metadata"))
    return rows.mapInPandas(run, f"{schema}, score double")

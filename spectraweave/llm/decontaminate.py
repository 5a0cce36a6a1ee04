"""Benchmark decontamination with suffix arrays over the training text.

Each shard of documents is turned into word numbers and a suffix array of the
shard is sorted on the first `window` words of each suffix. Every suffix of
every test item is found in it by binary search. Chains of found windows along
one alignment are the verbatim matches, each as long as it can be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, unused

#: Lower-cases A-Z; keeps digits, letters and every byte of a non-ASCII character.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
#: Words in a shard's suffix array, about.
SHARD_WORDS = 2_000_000
#: Bytes of test text that are searched for at once; more are searched in blocks of this size.
BLOCK_BYTES = 16_000_000

HITS = "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<start:int,end:int,item_id:long,item_start:int>>"


def words(text: str | None) -> list[bytes]:
    """Runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class Suffixes:
    """The test suffixes, sorted for search: one row per window of each item."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        self.window, self.number = window, {}
        rows, self.item, self.start, self.length = [], [], [], []
        for item_id, text in items:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words(text)]
            for at in range(max(len(w) - window, 0) + 1) if w else ():
                part = w[at : at + window]
                rows.append(part + [0] * (window - len(part)))
                self.item.append(-1 if item_id is None else item_id)
                self.start.append(at)
                self.length.append(len(part))
        n = np.array(rows, ">u4").reshape(len(rows), window)
        self.item, self.start, self.length = (np.array(x, np.int64) for x in (self.item, self.start, self.length))
        top = np.where(np.arange(window)[None, :] < self.length[:, None], n, 0xFFFFFFFF).astype(">u4")
        self.low, self.high = (np.ascontiguousarray(x).view(f"S{4 * window}").ravel() for x in (n, top))
        self.least = int(self.length.min()) if len(rows) else 0
        first = n[:, 0].astype(np.int64) * (len(self.number) + 1) + (n[:, 1] if self.least > 1 else 0)
        self.heads = np.unique(first)

    def search(self, docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(place in the joined documents, row of a window) of each occurrence; a 0 stands between documents."""
        k = self.window
        flat = np.fromiter((x for d in docs for x in (*d, 0)), np.int64)
        flat = np.concatenate((flat, np.zeros(k, np.int64)))
        # a suffix whose first words begin no test suffix can match none
        head = flat[:-1] * (len(self.number) + 1) + (flat[1:] if self.least > 1 else 0)
        at = np.searchsorted(self.heads, head[: len(flat) - k])
        place = np.nonzero((self.heads[np.minimum(at, len(self.heads) - 1)] == head[: len(flat) - k]) & (flat[: len(flat) - k] > 0))[0]
        keys = flat[place[:, None] + np.arange(k)[None, :]].astype(">u4").view(f"S{4 * k}").ravel()
        order = np.argsort(keys, kind="stable")
        array, keys = place[order], keys[order]
        lo, hi = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = hi - lo
        row = np.repeat(np.arange(len(n)), n)
        return array[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)], row


def _chains(doc: np.ndarray, start: np.ndarray, tests: Suffixes, row: np.ndarray) -> pd.DataFrame:
    """The longest verbatim matches: windows that follow one another on one alignment, joined."""
    f = pd.DataFrame({"doc": doc, "item": tests.item[row], "start": start, "from": tests.start[row], "n": tests.length[row]})
    f["line"] = f["start"] - f["from"]
    f = f.sort_values(["doc", "item", "line", "start"], kind="stable").drop_duplicates(["doc", "item", "line", "start"])
    same = (f[["doc", "item", "line"]] == f[["doc", "item", "line"]].shift()).all(axis=1) & (f["start"] == f["start"].shift() + 1)
    f["chain"] = (~same).cumsum()
    return f.groupby("chain").agg(doc=("doc", "first"), item=("item", "first"), start=("start", "first"), last=("start", "last"), n=("n", "last"), at=("from", "first"))


def _shard(ids: list, texts: list, tests: Suffixes) -> pd.DataFrame:
    number = tests.number.get
    docs = [[number(w, 0) for w in words(t)] for t in texts]
    sizes = np.array([len(d) for d in docs], np.int64)
    out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_words": sizes, "n_hit": 0})
    items: list[list[int]] = [[] for _ in ids]
    spans: list[list[tuple]] = [[] for _ in ids]
    if len(tests.low) and sizes.sum():
        place, row = tests.search(docs)
        begin = np.concatenate(([0], np.cumsum(sizes + 1)))
        change = np.zeros(begin[-1] + 1, np.int32)
        np.add.at(change, place, 1)
        np.add.at(change, place + tests.length[row], -1)
        hit = np.concatenate(([0], np.cumsum(np.cumsum(change) > 0)))
        out["n_hit"] = hit[begin[1:]] - hit[begin[:-1]]
        doc = np.searchsorted(begin, place, "right") - 1
        if len(doc):
            for c in _chains(doc, place - begin[doc], tests, row).itertuples(index=False):
                spans[c.doc].append((c.start, c.last + c.n, c.item if c.item >= 0 else None, c.at))
                if c.item >= 0:
                    items[c.doc].append(c.item)
    out["items"] = [sorted(set(x)) for x in items]
    out["spans"] = [[dict(zip(("start", "end", "item_id", "item_start"), s)) for s in x] for x in spans]
    return out


def _block_count(benchmark: DataFrame, text_col: str) -> int:
    """In how many blocks of a bounded size the test items are searched for."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string")) + 16), F.lit(0))).first()[0]
    return 1 + int(size) // (BLOCK_BYTES // 2)


def _block(benchmark: DataFrame, item_col: str, text_col: str, k: int, parts: int) -> list[tuple]:
    rows = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    return [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()]


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) for each row of docs.

    An occurrence of `window` consecutive words of an item, or of a whole item
    of fewer words, is a hit of each of its words. items: the ids of items that
    have one. spans: each longest verbatim match as [start, end) in the
    document's words, the item, and where in the item it starts. Null and empty
    texts have no words; an item without words never matches; words of an item
    whose id is null are hit, but it is not in items; equal rows give equal
    rows; an empty table on either side gives no hits. Test items are searched in
    blocks of bounded size; only one block at a time is sent to the executors.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = _block_count(benchmark, item_text_col)
    if parts == 1:
        return _search(rows, _block(benchmark, item_col, item_text_col, 0, 1), window)
    # several blocks: what each finds is written before the next is read, and their spans are joined again document by
    # document; the documents' numbers are written first, as they would not be the same when worked out again
    rows = checkpointed(rows.withColumn("row", F.monotonically_increasing_id()))
    keyed = None
    for k in range(parts):
        part = _search(rows.select(F.col("row").alias("doc_id"), "text"), _block(benchmark, item_col, item_text_col, k, parts), window)
        part = checkpointed(part if k == 0 else part.where("n_hit > 0"))
        keyed = part if keyed is None else keyed.unionByName(part)
    merged = keyed.groupBy("doc_id").agg(
        F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("spans"),
    )
    end = F.expr(
        "aggregate(array_sort(spans), named_struct('n', 0L, 'at', 0), (s, x) -> named_struct("
        "'n', s.n + greatest(0, x.end - greatest(s.at, x.start)), 'at', greatest(s.at, x.end)), s -> s.n)"
    )
    return (
        merged.withColumn("n_hit", end).withColumnRenamed("doc_id", "row").join(rows.select("row", "doc_id"), "row")
        .select("doc_id", "n_words", "n_hit", "items", "spans")
    )


def _search(rows: DataFrame, items: list[tuple], window: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests = Suffixes(shared.value, window)
        for b in batches:
            ids, texts = list(b["doc_id"]), list(b["text"])
            ids = [None if pd.isna(x) else int(x) for x in ids]
            begin, size = 0, 0
            for k, t in enumerate(texts):
                size += len(t or "") // 5
                if size >= SHARD_WORDS or k == len(texts) - 1:
                    yield _shard(ids[begin : k + 1], texts[begin : k + 1], tests)
                    begin, size = k + 1, 0

    return rows.mapInPandas(run, HITS)


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text shares no window with the benchmark, with all their columns.

    Rows with a null id are judged by their text like any other. Null and empty
    texts stay; equal rows stay or go together; an empty table on either side
    drops nothing; columns of any name are kept.
    """
    own = unused(docs, "__own")
    rows = docs.withColumn(own, F.xxhash64(F.col(id_col), F.col(text_col)))
    hit = matches(rows, benchmark, window, id_col=own, text_col=text_col).where("n_hit > 0").select(F.col("doc_id").alias(own)).distinct()
    return rows.join(hit, own, "left_anti").drop(own)

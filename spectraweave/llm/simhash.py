"""SimHash near-duplicates: fingerprints, then an exact tiled comparison of all of them.

A fingerprint is a 64-bit majority vote over the XXH64 values of word shingles.
Equal fingerprints are one node. Nodes are dealt into tiles by the population
counts of their two halves; a pair of tiles whose counts differ beyond the
radius holds no link and is never made. The other pairs are compared in full,
with numpy exclusive-or and bit counts, and each returns a spanning forest of
its links, so a large group of near copies doesn't become all its pairs.

Near copies by similarity (`near_copies`) take longer sketches with wide limits
only to find candidates, and link those whose sets of shingles really are that
similar.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, sized

SEED = 42
#: Fingerprints in a tile, about; a pair of tiles is one unit of work.
TILE = 4096
_ROWS = 256
_CHUNK = 1 << 16
#: Near copies share this part of all their shingles at least.
SIMILARITY = 0.8
#: Bits in which the first 64 and all 256 bits of two near copies' sketches may differ. At similarity 0.8 about 10 and 39
#: differ (12 and 48 for sets of five); the limits lie 3.9 standard deviations or more above that.
SKETCH_BITS = (24, 72)
#: Candidates a node may have in one pair of tiles in the first round, and the factor from round to round.
FIRST_CANDIDATES, MORE_CANDIDATES = 16, 8
#: Shingles of the sets in a block, about, of which each counts as so many more; a pair of blocks is verified at once.
BLOCK, _NODE = 1 << 16, 64


def _digests(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles, in parts; a text of fewer words is one shingle."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(ends), _CHUNK):
        yield np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:], ends[at : at + _CHUNK])], "<u8")


def _majority(parts: Iterable[np.ndarray]) -> int:
    """The majority vote over the bits of 64-bit numbers, as an unsigned number (none: 0)."""
    counts, n = np.zeros(64, np.int64), 0
    for h in parts:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint_text(text: str | None, shingle: int = 4) -> int:
    """The fingerprint of one text, as an unsigned number (no words: 0)."""
    return _majority(_digests(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) for each row; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([fingerprint_text(t, shingle) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, fp long")


def _forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (node, root) pairs, of the links between two tiles, or within one."""
    nodes = a if b is None else np.concatenate((a, b))
    other, shift = (a, 0) if b is None else (b, len(a))
    root = np.arange(len(nodes))
    for at in range(0, len(a), _ROWS):
        i, j = np.nonzero(np.bitwise_count(a[at : at + _ROWS, None] ^ other[None, :]) <= radius)
        i, j = i + at, j + shift
        while True:
            ri, rj = root[i], root[j]
            open_ = ri != rj
            if not open_.any():
                break
            i, j, ri, rj = i[open_], j[open_], ri[open_], rj[open_]
            np.minimum.at(root, np.maximum(ri, rj), np.minimum(ri, rj))
            while (step := root[root]).tobytes() != root.tobytes():
                root = step
    moved = np.nonzero(root != np.arange(len(root)))[0]
    return nodes[moved], nodes[root[moved]]


def links(prints: DataFrame, radius: int = 4, tile: int = TILE) -> DataFrame:
    """(u, v): links of distinct fingerprints(fp) whose reachability is that of all links within the radius."""
    halves = prints.select(
        "fp", F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo")
    )
    # at most 33 x 33 rows, whatever the input
    cells = halves.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    dealt = halves.join(F.broadcast(cells), ["hi", "lo"]).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    tiles = checkpointed(
        dealt.groupBy("hi", "lo", "part")
        .agg(F.collect_list("fp").alias("fps"))
        .withColumn("tile", F.col("hi").cast("long") * (1 << 40) + F.col("lo").cast("long") * (1 << 32) + F.col("part"))
    )
    near = [(d, e) for d in range(radius + 1) for e in range(-radius, radius + 1) if d + abs(e) <= radius and (d, e) >= (0, 0)]
    offsets = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(e).alias("e")) for d, e in near])
    left = tiles.select(F.col("tile").alias("a"), "hi", "lo", F.explode(offsets).alias("o")).select(
        "a", (F.col("hi") + F.col("o.d")).alias("hi"), (F.col("lo") + F.col("o.e")).alias("lo")
    )
    pairs = left.join(tiles.select(F.col("tile").alias("b"), "hi", "lo"), ["hi", "lo"]).where("a <= b or a >> 32 <> b >> 32").select("a", "b")
    work = (
        pairs.join(tiles.select(F.col("tile").alias("a"), F.col("fps").alias("fa")), "a")
        .join(tiles.select(F.col("tile").alias("b"), F.col("fps").alias("fb")), "b")
        .select((F.col("a") == F.col("b")).alias("same"), "fa", "fb")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for same, fa, fb in zip(batch["same"], batch["fa"], batch["fb"]):
                a, b = np.asarray(fa, np.int64).view(np.uint64), np.asarray(fb, np.int64).view(np.uint64)
                u, v = _forest(a, None if same else b, radius)
                if len(u):
                    yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return work.mapInPandas(compare, "u long, v long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4, tile: int = TILE
) -> DataFrame:
    """(doc_id, fp long, component_id long) for each row of docs.

    component_id is the smallest doc_id that links of at most `radius` differing
    bits reach. Texts without words share fingerprint 0 and are linked like any
    other. A null doc_id keeps its row, and never is a component's id unless all
    of the component's ids are null. Equal rows give equal rows; an empty table
    gives an empty result; other columns of docs are not looked at.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    nodes = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes.select("fp"), radius, tile))
    named = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "root").join(lows, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """The distinct hashes of a text's word shingles, in order."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *_digests(text, shingle)]))


def _sketch(hashes: np.ndarray) -> list[int]:
    """Four fingerprints of a set, each over the set's hashes mixed in another way."""
    out = []
    for n in range(1, 5):
        h = hashes + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
        out.append(_majority(h[at : at + _CHUNK] for at in range(0, len(h), _CHUNK)))
    return out


def _sketched(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, tag, key, n, sketch) for each row: hashes of the text and of its set of shingles, the set's size and its sketch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, shingle) for t in b["text"]]
            key = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in sets], np.uint64).view(np.int64)
            sketch = [np.array(_sketch(h), np.uint64).view(np.int64) for h in sets]
            yield pd.DataFrame({"doc_id": b["doc_id"], "tag": b["tag"], "key": key, "n": [len(h) for h in sets], "sketch": sketch})

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tag"), text.alias("text"))
    return rows.mapInPandas(run, "doc_id long, tag long, key long, n long, sketch array<long>")


def _candidates(a: np.ndarray, b: np.ndarray | None, similarity: float, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (u, v) of keys that may be similar, of two tiles or within one, from rows (key, n, group, sketch).

    Pairs of one group need no look. A node gets `limit` pairs at most; both ends
    of a pair beyond that come as (key, key), to be looked at again.
    """
    other = a if b is None else b
    for at in range(0, len(a), _ROWS):
        x = a[at : at + _ROWS]
        i, j = np.nonzero(np.bitwise_count(x[:, None, 3] ^ other[None, :, 3]) <= SKETCH_BITS[0])
        open_ = x[i, 2] != other[j, 2]
        if b is None:
            open_ &= j > i + at
        i, j = i[open_], j[open_]
        sizes = x[i, 1].astype(float), other[j, 1].astype(float)
        fits = np.minimum(*sizes) / np.maximum(*sizes) >= similarity
        i, j = i[fits], j[fits]
        fits = np.bitwise_count(x[i, 3:] ^ other[j, 3:]).sum(axis=1) <= SKETCH_BITS[1]
        i, j = i[fits], j[fits]
        late = np.arange(len(i)) - np.searchsorted(i, i) >= limit
        yield x[i[~late], 0], other[j[~late], 0]
        again = np.unique(np.concatenate((x[i[late], 0], other[j[late], 0])))
        yield again, again


def _met(nodes: DataFrame, count: int, similarity: float, limit: int, tile: int) -> DataFrame:
    """(u, v): candidates among `count` nodes(key, n, group, sketch), and (u, u) for nodes that have more of them.

    Sets of one band of sizes and of the next are compared: others differ too much in size.
    """
    band = F.floor(F.log("n") / F.log(F.lit(1.0001 / similarity))).cast("long")
    banded = nodes.select("key", F.array("key", "n", "group", *[F.get("sketch", F.lit(k)) for k in range(4)]).alias("row"), band.alias("band"))
    # a row for each band, whose number grows with the logarithm of the longest text
    cells = banded.groupBy("band").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    dealt = banded.join(F.broadcast(cells), "band").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("long"))
    filled = dealt.groupBy("band", "part").agg(F.flatten(F.collect_list("row")).alias("rows")).withColumn("tile", F.col("band") * (1 << 40) + F.col("part"))
    tiles = checkpointed(sized(filled, count))
    left = tiles.select(F.col("tile").alias("a"), F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    pairs = left.join(tiles.select(F.col("tile").alias("b"), "band"), "band").where("a <= b").select("a", "b")
    work = (
        pairs.join(tiles.select(F.col("tile").alias("a"), F.col("rows").alias("ra")), "a")
        .join(tiles.select(F.col("tile").alias("b"), F.col("rows").alias("rb")), "b")
        .select((F.col("a") == F.col("b")).alias("same"), "ra", "rb")
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for same, ra, rb in zip(batch["same"], batch["ra"], batch["rb"]):
                a, b = (np.asarray(r, np.int64).view(np.uint64).reshape(-1, 7) for r in (ra, rb))
                for u, v in _candidates(a, None if same else b, similarity, limit):
                    if len(u):
                        yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return work.mapInPandas(compare, "u long, v long").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _blocked(pairs: DataFrame, count: int, nodes: DataFrame) -> DataFrame:
    """(key, tag, block) of the nodes of `count` pairs(u, v), in blocks of about BLOCK shingles of nodes that mostly meet each other.

    A node's label is the least key within two steps; the nodes of one label are dealt into as many blocks as their sizes need.
    """
    few = partial(sized, rows=2 * count)
    both = few(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    low = few(both.groupBy("u").agg(F.least("u", F.min("v")).alias("label")))
    label = few(few(both.join(low.select(F.col("u").alias("v"), "label"), "v")).groupBy(F.col("u").alias("key")).agg(F.min("label").alias("label")))
    labelled = checkpointed(few(nodes.select("key", "tag", "n").join(label, "key")))
    parts = few(labelled.groupBy("label").agg(F.ceil(F.sum(F.col("n") + _NODE) / BLOCK).alias("parts")))
    return few(labelled.join(parts, "label").select("key", "tag", F.xxhash64("label", F.pmod(F.xxhash64("key"), "parts")).alias("block")))


def _sets(rows: np.ndarray) -> dict[int, np.ndarray]:
    """The sets of a block by key, from key, size and hashes one after the other."""
    out, at = {}, 0
    while at < len(rows):
        key, n = rows[at : at + 2].tolist()
        out[key] = rows[at + 2 : at + 2 + n]
        at += 2 + n
    return out


def _verified(u: np.ndarray, v: np.ndarray, sets: dict[int, np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of keys have sets (sorted) that are similar."""
    order, good = np.argsort(u, kind="stable"), np.zeros(len(u), bool)
    for run in np.split(order, np.nonzero(np.diff(u[order]))[0] + 1):
        one, others = sets[int(u[run[0]])], [sets[k] for k in v[run].tolist()]
        sizes, all_ = np.array([len(o) for o in others]), np.concatenate(others)
        found = one[np.minimum(np.searchsorted(one, all_), len(one) - 1)] == all_
        common = np.add.reduceat(found, np.cumsum(sizes) - sizes, dtype=np.int64)
        good[run] = common / (len(one) + sizes - common) >= similarity
    return good


def _similar(pairs: DataFrame, count: int, nodes: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """Those of `count` pairs(u, v) of nodes whose sets of shingles are similar, by the sets themselves.

    A set travels once for each pair of blocks that has work for its block, not once for each of its pairs.
    """
    named = checkpointed(_blocked(pairs, count, nodes))
    text = F.col(text_col).cast("string")
    texts = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("tag"), text.alias("text")).join(named, "tag").groupBy("key", "block").agg(F.first("text").alias("text"))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.sort(shingle_set(t, shingle).view(np.int64)) for t in b["text"]]
            yield pd.DataFrame({"block": b["block"], "row": [np.concatenate(([k, len(h)], h)) for k, h in zip(b["key"], sets)]})

    blocks = checkpointed(texts.mapInPandas(listed, "block long, row array<long>").groupBy("block").agg(F.flatten(F.collect_list("row")).alias("rows")))
    block = named.select("key", "block")
    few = partial(sized, rows=count)
    placed = few(pairs.join(block.select(F.col("key").alias("u"), F.col("block").alias("a")), "u"))
    placed = few(placed.join(block.select(F.col("key").alias("v"), F.col("block").alias("b")), "v"))
    meet = checkpointed(few(placed.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.collect_list("u").alias("us"), F.collect_list("v").alias("vs"))))
    first, second = blocks.select(F.col("block").alias("a"), F.col("rows").alias("ra")), blocks.select(F.col("block").alias("b"), F.col("rows").alias("rb"))
    within = meet.where("a = b").join(first, "a").select("us", "vs", "ra", F.lit(None).cast("array<long>").alias("rb"))
    across = meet.where("a <> b").join(first, "a").join(second, "b").select("us", "vs", "ra", "rb")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for us, vs, ra, rb in zip(batch["us"], batch["vs"], batch["ra"], batch["rb"]):
                u, v = np.asarray(us, np.int64), np.asarray(vs, np.int64)
                good = _verified(u, v, _sets(ra) | ({} if rb is None else _sets(rb)), similarity)
                yield pd.DataFrame({"u": u[good], "v": v[good]})

    return within.unionByName(across).mapInPandas(verify, "u long, v long")


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = 5, tile: int = 2 * TILE
) -> DataFrame:
    """(doc_id, component_id long) for each row of docs.

    component_id is the smallest doc_id that links reach; two texts are linked
    if the Jaccard similarity of their sets of word shingles is at least
    `similarity` (0.8 or more, for which the sketches' limits are made). Texts
    without words are copies of each other. A null doc_id keeps its row.

    Candidates are verified in rounds: a node with very many gets only some at
    first; what these link is one group, within which nothing more need be
    compared, and the rest of its candidates follow in later, larger rounds.
    """
    rows = checkpointed(_sketched(docs, id_col, text_col, shingle))
    nodes = checkpointed(rows.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("tag").alias("tag"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    total = nodes.count()
    nodes = sized(nodes, total)
    looked, count, limit = nodes.where("n > 0").select("key", "n", F.col("key").alias("group"), "sketch"), total, FIRST_CANDIDATES
    tested = linked = roots = None
    made = 0
    while True:
        met = checkpointed(_met(looked, count, similarity, limit, tile))
        new, open_ = met.agg(F.count_if(F.col("u") != F.col("v")), F.count_if(F.col("u") == F.col("v"))).first()
        met, made = sized(met, new + open_), made + new
        fresh = met.where("u <> v")
        fresh = checkpointed(sized(fresh.join(tested, ["u", "v"], "left_anti"), new)) if tested is not None else fresh
        near = checkpointed(_similar(fresh, new, nodes, docs, text_col, shingle, similarity))
        tested = fresh if tested is None else sized(tested.unionByName(fresh), made)
        linked = sized(near if linked is None else linked.unionByName(near), made)
        roots = connected_components(linked).select(F.col("node").alias("key"), "root")
        if not open_:
            break
        again = met.where("u = v").select(F.col("u").alias("key"))
        joined = sized(sized(nodes.join(again, "key"), open_).join(roots, "key", "left"), open_)
        looked, count = checkpointed(joined.select("key", "n", F.coalesce("root", "key").alias("group"), "sketch")), open_
        limit *= MORE_CANDIDATES
    named = sized(nodes.join(roots, "key", "left"), total).select("key", "least", F.coalesce("root", "key").alias("root"))
    lows = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.select("key", "root").join(lows, "root"), "key").select("doc_id", "component_id")

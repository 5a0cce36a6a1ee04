"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to. The flow runs
pattern -> source -> sink: a pattern can send its size once at no cost, a second
time at a cost of 1 a word, and so on (convex repetition costs); a source takes
its target. Spark does the aggregation and the selection of documents; only one
row per pattern comes to the driver, and their number is checked.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed

WEIGHTS = (5, 2, 1)
#: Most membership patterns, and most sources, that the flow is solved for.
MAX_PATTERNS = 100_000
#: Most patterns of two or more sources.
MAX_SHARED = 2_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Share `total` by weight; no share above `most` times its size, the excess shared again by weight."""
    out, left, pool = {}, total, sum(weights[s] for s in sizes)
    for s in sorted(sizes, key=lambda s: most * sizes[s] / weights[s]):
        out[s] = min(most * sizes[s], left * weights[s] / pool) if pool > 0 else 0.0
        left, pool = left - out[s], pool - weights[s]
    return out


def min_cost_flow(sizes: dict[frozenset, float], quota: dict, repeats: int) -> dict[tuple[frozenset, object], float]:
    """Words sent from each pattern to each of its sources.

    Levels of cost are filled in turn, each to a maximum flow by shortest
    augmenting paths that may reroute what was sent before. As every unit of a
    level costs the same from any pattern, that is a min-cost flow.
    """
    sent: dict = defaultdict(float)
    used: dict = defaultdict(float)
    room, start = dict(quota), object()  # None is a source
    of = defaultdict(list)
    for p in sizes:
        for s in p:
            of[s].append(p)
    key = lambda x: (x is None, str(x))
    for level in range(1, repeats + 1):
        for p in sizes:
            if len(p) == 1:
                (s,) = p
                if len(of[s]) == 1:
                    used[p] += (x := min(level * sizes[p] - used[p], room[s]))
                    sent[p, s] += x
                    room[s] -= x
        shared = [p for p in sizes if any(len(of[s]) > 1 for s in p)]
        for p in sorted(shared, key=lambda p: (len(p), sorted(map(key, p)))):
            while level * sizes[p] - used[p] > 1e-6:
                came, queue, end = {s: (p, start) for s in sorted(p, key=key)}, sorted(p, key=key), start
                while queue and end is start:
                    s = queue.pop(0)
                    if room[s] > 1e-6:
                        end = s
                        break
                    for q in of[s]:
                        if sent[q, s] > 1e-6:
                            for t in sorted(q, key=key):
                                if t not in came:
                                    came[t] = (q, s)
                                    queue.append(t)
                if end is start:
                    break
                path, s = [], end
                while s is not start:
                    path.append((came[s][0], s, came[s][1]))
                    s = came[s][1]
                x = min([level * sizes[p] - used[p], room[end], *(sent[q, b] for q, _, b in path if b is not start)])
                for q, a, b in path:
                    sent[q, a] += x
                    if b is not start:
                        sent[q, b] -= x
                used[p] += x
                room[end] -= x
    return {k: v for k, v in sent.items() if v > 0}


def mix(
    docs: DataFrame,
    sources: Column,
    size: Column,
    id_col: str = "doc_id",
    total: float = 1.5,
    repeats: int = 2,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 7,
    bins: int = 4096,
) -> DataFrame:
    """(doc_id, sources array, size, taken, target, source_size) for each row of docs.

    `sources` is the array of sources of a row, where null is a source of its
    own; an empty or null array takes no part and gets target 0. Sources by code
    point, null last, weigh `weights` in turn and share `total` times all sizes,
    none above `repeats` times its own. Within a pattern, documents come in the
    order of the MD5 of seed and id: each is taken whole floor(take / size)
    times, and once more until the rest is reached, to the nearest document.
    target and source_size are sums over the row's sources. Rows of one id come
    in the order of their sizes, and equal rows are taken alike up to one place; empty texts are size 0; an empty table gives none.
    """
    rows = checkpointed(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.array_sort(F.array_distinct(sources)).alias("sources"),
            F.coalesce(size, F.lit(0)).cast("long").alias("size"),
        ).withColumn("turn", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    )
    grouped = rows.where("size(sources) > 0").groupBy("sources").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(grouped) > MAX_PATTERNS or sum(len(r.sources) > 1 for r in grouped) > MAX_SHARED:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns, or over {MAX_SHARED} of several sources")
    sizes = {frozenset(r.sources): r.size for r in grouped}
    own: dict = defaultdict(int)
    for p, n in sizes.items():
        for s in p:
            own[s] += n
    order = sorted(own, key=lambda s: (s is None, s or ""))
    weigh = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    quota = targets(own, weigh, total * sum(sizes.values()), repeats)
    flow = min_cost_flow(sizes, quota, repeats)
    take: dict = defaultdict(float)
    for (p, _), x in flow.items():
        take[p] += x
    plan = [
        (r.sources, min(repeats, int(take[p] / r.size)) if r.size else 0, take[p], r.size, float(sum(quota[s] for s in p)), sum(own[s] for s in p))
        for r in grouped
        for p in [frozenset(r.sources)]
    ]
    plan_df = docs.sparkSession.createDataFrame(plan, "sources array<string>, whole int, take double, all long, target double, source_size long")
    plan_df = plan_df.select("sources", "whole", (F.col("take") - F.col("whole") * F.col("all")).alias("rest"), "target", "source_size")
    width = len(f"{bins - 1:x}")
    binned = rows.withColumn("bin", F.conv(F.substring("turn", 1, width), 16, 10).cast("int"))
    ahead = Window.partitionBy("sources").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    filled = (
        binned.where("size(sources) > 0")
        .groupBy("sources", "bin")
        .agg(F.sum("size").alias("in_bin"))
        .withColumn("upto", F.sum("in_bin").over(ahead))
        .join(F.broadcast(plan_df), "sources")
        .where("upto > rest")
        .groupBy("sources")
        .agg(F.min(F.struct("bin", (F.col("upto") - F.col("in_bin")).alias("before"))).alias("edge"))
    )
    # one row a pattern, whose number is checked above
    full = plan_df.join(filled, "sources", "left").select(
        F.col("sources").alias("pattern"), "whole", "rest", "target", "source_size", F.col("edge.bin").alias("edge"), "edge.before"
    )
    out = binned.join(F.broadcast(full), F.col("sources") == F.col("pattern"), "left")
    at_edge = F.col("bin") == F.col("edge")
    inside = Window.partitionBy("sources").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = out.where(at_edge).withColumn("upto", F.col("before") + F.sum("size").over(inside))
    more = edge.withColumn("more", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("int"))
    rest = out.where(~F.coalesce(at_edge, F.lit(False))).withColumn("more", F.coalesce(F.col("bin") < F.coalesce("edge", F.lit(bins)), F.lit(False)).cast("int"))
    cols = ["doc_id", "sources", "size"]
    both = more.select(*cols, "whole", "more", "target", "source_size").unionByName(rest.select(*cols, "whole", "more", "target", "source_size"))
    taken = F.coalesce(F.col("size") * F.least(F.col("whole") + F.col("more"), F.lit(repeats)), F.lit(0)).cast("long")
    return both.select(*cols, taken.alias("taken"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("source_size", F.lit(0)).alias("source_size"))

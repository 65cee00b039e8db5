"""Mixing sources to target weights as a min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them). Each pattern can
supply its tokens once at no cost and again at rising (convex) cost; each source demands its target.
The flow over this small graph says how many tokens each pattern supplies; documents of a pattern
are then taken in a seeded order until that amount is met: whole rounds first, the last round up
to the boundary document, of which the mix takes the words that are still wanted.

The seeded order is that of md5(seed:doc_id); running sums are split by the first digits of the
digest, so no source is summed in one task. Null texts have size 0 and are never taken; null sources
are a source of their own, the last; repeated rows count each; reruns agree; empty tables
give no rows.
"""

from __future__ import annotations

import json
import math
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
MAX_PATTERNS = 20_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def water_fill(sizes: list[float], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, none above cap * size; the excess goes to the others by weight."""
    target, open_ = [0.0] * len(sizes), [i for i in range(len(sizes))]
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = cap * sizes[i]
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def min_cost_flow(patterns: list[tuple[tuple[int, ...], float]], quotas: list[float], rounds: int) -> list[dict[int, float]]:
    """Tokens that each pattern (sources, size) sends to each source.

    Round r of a pattern costs r - 1 a token, so a pattern repeats only where no pattern with a
    cheaper round can serve the quota, directly or by rerouting. Rounds rise in cost alike for all patterns,
    so augmenting round by round along residual paths is successive shortest paths."""
    sent: list[dict[int, float]] = [dict.fromkeys(p, 0.0) for p, _ in patterns]
    need = list(quotas)
    into: list[list[int]] = [[] for _ in quotas]
    for i, (sources, _) in enumerate(patterns):
        for s in sources:
            into[s].append(i)
    for _ in range(rounds):
        spare = [float(size) for _, size in patterns]
        for i, (sources, _) in enumerate(patterns):
            while spare[i] > 1e-9:
                # breadth first from pattern i to a source that still needs tokens
                back: dict[tuple[str, int], tuple[str, int] | None] = {("p", i): None}
                queue, goal = deque([("p", i)]), None
                while queue and goal is None:
                    kind, x = queue.popleft()
                    for y in patterns[x][0] if kind == "p" else into[x]:
                        node = ("s", y) if kind == "p" else ("p", y)
                        if node in back or kind == "s" and sent[y][x] <= 1e-9:
                            continue
                        back[node] = (kind, x)
                        if kind == "p" and need[y] > 1e-9:
                            goal = node
                            break
                        queue.append(node)
                if goal is None:
                    break
                path = [goal]
                while back[path[-1]] is not None:
                    path.append(back[path[-1]])
                path.reverse()
                amount = min([spare[i], need[goal[1]], *(sent[path[k + 1][1]][path[k][1]] for k in range(1, len(path) - 1, 2))])
                for k in range(0, len(path) - 1, 2):
                    sent[path[k][1]][path[k + 1][1]] += amount
                for k in range(1, len(path) - 1, 2):
                    sent[path[k + 1][1]][path[k][1]] -= amount
                spare[i] -= amount
                need[goal[1]] -= amount
    return sent


def source_targets(sizes: list[tuple[str | None, float]], weights=(5, 2, 1), factor: float = 1.5, cap: float = 2.0) -> list[float]:
    """Targets of sources that come in order, weighing ``weights`` in turn."""
    return water_fill([s for _, s in sizes], [weights[i % len(weights)] for i in range(len(sizes))], factor * sum(s for _, s in sizes), cap)


def mix(docs: DataFrame, seed: int = 1, weights=(5, 2, 1), factor: float = 1.5, cap: int = 2, sources: str = "sources") -> DataFrame:
    """docs (doc_id, size, an array of sources, and others) with source_size, target and ``taken``, the words that the mix takes.

    A document of several sources serves any of them; its source_size and target are those of the first by name (null last), whatever
    the order in its array. A missing or empty array is the null source. Columns of docs that have the names of results are replaced."""
    spark = docs.sparkSession
    docs = docs.drop("source_size", "target", "taken")
    named = F.transform(F.array_distinct(sources), lambda s: F.coalesce(F.concat(F.lit("s"), s), F.lit("~null")))
    key = F.to_json(F.array_sort(F.when(F.size(sources) > 0, named).otherwise(F.array(F.lit("~null")))))
    # the row travels as one column, so its names can't meet those of the work
    tagged = docs.select(F.struct("*").alias("row"), "doc_id", "size", key.alias("key"))
    found = sorted(tagged.groupBy("key").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect())
    if len(found) > MAX_PATTERNS:
        raise ValueError("too many membership patterns")
    members = [[None if s == "~null" else s[1:] for s in json.loads(r["key"])] for r in found]
    names = sorted({s for m in members for s in m}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    own = [0] * len(names)
    for r, m in zip(found, members, strict=True):
        for s in m:
            own[number[s]] += r["size"] or 0
    targets = source_targets(list(zip(names, own, strict=True)), weights, factor, cap)
    # whole words: each source's target to the nearest one
    sent = min_cost_flow([(tuple(number[s] for s in m), float(r["size"] or 0)) for r, m in zip(found, members, strict=True)], [float(math.floor(t + 0.5)) for t in targets], cap)
    plan = spark.createDataFrame(
        [(r["key"], float(targets[number[m[0]]]), own[number[m[0]]], int(r["size"] or 0), int(round(sum(f.values())))) for r, m, f in zip(found, members, sent, strict=True)],
        "key string, target double, source_size long, whole long, supply long",
    )
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = tagged.join(F.broadcast(plan), "key").withColumn("digest", digest).withColumn("part", F.substring("digest", 1, 3))
    sums = keyed.groupBy("key", "part").agg(F.sum("size").alias("n"))
    sums = sums.select("key", "part", (F.sum("n").over(W.partitionBy("key").orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("size").over(W.partitionBy("key", "part").orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    before = keyed.withColumn("inside", inside).join(sums, ["key", "part"])
    rounds = F.expr("if(whole = 0, 0L, supply div whole)")
    rest = F.col("supply") - rounds * F.col("whole") - F.col("base") - F.col("inside")
    taken = rounds * F.col("size") + F.least(F.col("size"), F.greatest(F.lit(0), rest))
    return before.select("row.*", "source_size", "target", taken.cast("long").alias("taken"))

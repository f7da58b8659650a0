"""Mixing overlapping sources to target weights by min-cost flow.

Texts that several sources hold are supply all of them can use, but using them in each repeats them.
Documents are aggregated by membership pattern (the set of sources that hold their text). Flow runs
from each pattern, through the sources of its members, to the quotas: a document may be taken twice
at most, so pattern P can send a source twice the words it has there, and repeating the words of a
pattern costs more each time (1 for the first use, 2 for the second, 4 up to the fourth, 8 up to
the eighth, ...). The flow that fills the quotas at least cost takes words that are held once before
it repeats shared ones. As only the arcs into patterns cost anything and their costs rise, the least
cost is reached by opening the arcs by price and taking the maximum flow each time.

The driver sees sources and patterns, not documents. Every pattern takes part in the flow, so the
driver's memory grows with the arcs, the occupied (pattern, source) pairs. ``PATTERNS`` chooses only
how the shares get back to the texts: broadcast up to so many arcs, by shuffle above. The flow fixes
what share of each (pattern, source) is taken, and seeded documents are drawn to those shares: in each
source they are ordered by a hash over the share, and whole documents are taken up to the quota.
The quota ends inside at most one document of a source, which is taken in part. A histogram of the
order finds that place, so no source is sorted in one task.
"""

from __future__ import annotations

import uuid
from collections import deque
from itertools import cycle

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from covertile.plans.workspace import Workspace

from .rows import identified
from .sharding import text_key

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
PATTERNS = 20_000
BUCKETS = 4096
PER_UNIT = 1024


@F.arrow_udf(LongType())
def word_count(texts: pa.Array) -> pa.Array:
    return pa.array([len(t.encode("utf-8").split()) if t else 0 for t in texts.to_pylist()], pa.int64())


def targets(sizes: dict, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> dict:
    """Words for each source: ``share`` of all words by weight, at most ``most`` times its own.

    Sources take the weights in turn, by code point, null last. What a capped source can't use
    goes to the others by weight, until none is above its cap.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = dict(zip(order, cycle(weights)))
    total, open_, out = share * sum(sizes.values()), list(order), {}
    while open_:
        left = total - sum(out.values())
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            out.update({s: unit * weight[s] for s in open_})
            break
        out.update({s: float(most * sizes[s]) for s in full})
        open_ = [s for s in open_ if s not in full]
    return out


class Flow:
    """Integer maximum flow by shortest augmenting phases; capacities may be raised between runs."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.head: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        for node, to, r in ((a, b, room), (b, a, 0)):
            self.arcs[node].append(len(self.head))
            self.head.append(to)
            self.room.append(r)
        return len(self.head) - 2

    def run(self, source: int, sink: int) -> None:
        while True:
            depth = [-1] * len(self.arcs)
            depth[source] = 0
            queue = deque([source])
            while queue and depth[sink] < 0:
                at = queue.popleft()
                for e in self.arcs[at]:
                    if self.room[e] and depth[self.head[e]] < 0:
                        depth[self.head[e]] = depth[at] + 1
                        queue.append(self.head[e])
            if depth[sink] < 0:
                return
            tried = [0] * len(self.arcs)
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    cut = next(i for i, e in enumerate(path) if not self.room[e])
                    at = self.head[path[cut] ^ 1]
                    del path[cut:]
                    continue
                while tried[at] < len(self.arcs[at]):
                    e = self.arcs[at][tried[at]]
                    if self.room[e] and depth[self.head[e]] == depth[at] + 1:
                        path.append(e)
                        at = self.head[e]
                        break
                    tried[at] += 1
                else:
                    if not path:
                        break
                    at = self.head[path.pop() ^ 1]
                    tried[at] += 1


def route(supply: dict[tuple, dict[int, int]], words: dict[tuple, int], quotas: dict[int, int], most: int = MOST):
    """(pattern, source) -> words taken, filling ``quotas`` at least repetition cost.

    ``supply[pattern][source]`` are the words of the pattern's rows in a source, ``words[pattern]``
    its words without repeats.
    """
    patterns = sorted(supply)
    sources = sorted(quotas)
    node = {s: 2 + i for i, s in enumerate(sources)}
    flow = Flow(2 + len(sources) + len(patterns))
    for s in sources:
        flow.arc(node[s], 1, quotas[s])
    into, out = {}, {}
    for i, p in enumerate(patterns):
        at = 2 + len(sources) + i
        into[p] = flow.arc(0, at, 0)
        for s in sorted(supply[p]):
            out[p, s] = flow.arc(at, node[s], most * supply[p][s])
    opened = dict.fromkeys(patterns, 0)
    level, wanted = 1, sum(quotas.values())
    while True:
        more = False
        for p in patterns:
            limit = min(level * words[p], most * sum(supply[p].values()))
            if limit > opened[p]:
                flow.room[into[p]] += limit - opened[p]
                opened[p], more = limit, True
        if not more:
            break
        flow.run(0, 1)
        if sum(flow.room[e ^ 1] for e in into.values()) >= wanted:
            break
        level *= 2
    return {k: flow.room[e ^ 1] for k, e in out.items()}


def _unit(*key: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    keep: dict[str, Column] | None = None,
    seed: int = 0,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    whole: bool = False,
) -> DataFrame:
    """Per row: the ``keep`` columns (``doc_id`` unless given), size, source_size, target, taken.

    Sizes are words; a null or wordless text has none and nothing of it is taken. Null is a source
    of its own. Repeated rows are rows of their own. With ``whole`` the document in which a quota
    ends is taken or left as a whole, whichever is nearer. The same rows and seed give the same mix.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "mixing")
    keep = keep or {"doc_id": F.col(doc_id)}
    names = [f"keep_{i}" for i in range(len(keep))]
    rows = ws.write(
        docs.select(
            *(c.alias(n) for n, c in zip(names, keep.values())),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            *text_key(F.col(text)),
            _unit(F.lit(seed), F.col(doc_id), *text_key(F.col(text))).alias("unit"),
        ),
        "rows",
    )
    sizes = {r[0]: r[1] for r in rows.groupBy("source").agg(F.sum("size")).collect()}
    wanted = targets(sizes, weights, share, most)
    rank = {s: i for i, s in enumerate(wanted)}
    listed = spark.createDataFrame(
        [(s, rank[s], sizes[s], wanted[s]) for s in rank],
        "named string, rank int, source_size bigint, target double",
    )
    # Tables with a row for each source came from the driver: they are small enough to broadcast, and
    # a hot source is not dealt to one task.
    named = F.broadcast(listed)
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("named"))).drop("source", "named")

    held = rows.where("size > 0").groupBy("k1", "k2", "rank").agg(F.sum("size").alias("words"), F.max("size").alias("size"))
    texts = held.groupBy("k1", "k2").agg(
        F.sort_array(F.collect_list(F.struct("rank", "words"))).alias("members"), F.max("size").alias("size")
    )
    # Patterns go by two hashes: an arc with the whole pattern would make a large one quadratic.
    texts = texts.withColumn("pattern", F.col("members.rank")).withColumns(
        {"p1": F.xxhash64("pattern"), "p2": F.xxhash64(F.lit(1), "pattern")}
    )
    arcs = (
        texts.select("p1", "p2", "size", F.explode("members").alias("m"))
        .groupBy("p1", "p2", F.col("m.rank").alias("rank"))
        .agg(F.sum("m.words").alias("words"), F.sum("size").alias("own"))
        .toArrow()
    )
    members: dict[tuple, dict[int, int]] = {}
    own: dict[tuple, int] = {}
    for batch in arcs.to_batches():
        for p1, p2, r, words, n in zip(*(c.to_pylist() for c in batch.columns)):
            members.setdefault((p1, p2), {})[r] = words
            own[p1, p2] = n
    # Numbered in the order of their sources.
    names_of = sorted(members, key=lambda p: sorted(members[p]))
    supply = {i: members[p] for i, p in enumerate(names_of)}
    distinct = {i: own[p] for i, p in enumerate(names_of)}
    quotas = {rank[s]: int(wanted[s]) for s in rank}
    taken = route(supply, distinct, quotas, most)
    ratio = {k: x / supply[k[0]][k[1]] for k, x in taken.items()}
    left = dict.fromkeys(quotas, 0)
    for (p, s), x in taken.items():
        left[s] += x - int(ratio[p, s]) * supply[p][s]
    alone = {s: v for (p, s), v in ratio.items() if len(supply[p]) == 1}
    listed = spark.createDataFrame(
        [(*names_of[p], s, v) for (p, s), v in ratio.items() if len(supply[p]) > 1],
        "p1 bigint, p2 bigint, rank int, ratio double",
    )
    if len(ratio) <= PATTERNS:
        listed = F.broadcast(listed)
    of_source = spark.createDataFrame(
        [(s, alone.get(s, 0.0), left[s]) for s in quotas],
        "rank int, own_ratio double, left bigint",
    )
    # Only texts of several sources need their pattern; they are a part of the rows.
    of_text = (
        texts.where(F.size("pattern") > 1)
        .select("k1", "k2", "p1", "p2", F.explode("pattern").alias("rank"))
        .join(listed, ["p1", "p2", "rank"])
        .select("k1", "k2", "rank", "ratio")
    )
    share_of = F.when(F.col("size") == 0, 0.0).otherwise(F.coalesce("ratio", "own_ratio"))
    rows = (
        rows.join(of_text, ["k1", "k2", "rank"], "left")
        .join(F.broadcast(of_source), "rank")
        .withColumn("ratio", share_of)
        .withColumn("times", F.floor("ratio"))
        .withColumn("part", F.col("ratio") - F.col("times"))
        .withColumn("place", F.when(F.col("part") > 0, F.col("unit") / F.col("part")))
        # ``least`` passes over nulls: rows taken in whole times have no bucket.
        .withColumn(
            "bucket",
            F.when(
                F.col("part") > 0, F.least(F.floor(F.col("place") * PER_UNIT), F.lit(BUCKETS - 1))
            ).cast("int"),
        )
    )
    rows = ws.write(rows, "placed")
    upto = Window.partitionBy("rank").orderBy("bucket")
    cut = (
        rows.where("bucket IS NOT NULL")
        .groupBy("rank", "bucket")
        .agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        .withColumn("before", F.sum("words").over(upto) - F.col("words"))
        .where("before <= left AND left < before + words")
        .select("rank", F.col("bucket").alias("cut"), F.col("before"))
    )
    rows = rows.join(F.broadcast(cut), "rank", "left")
    inside = rows.where(F.col("bucket") == F.col("cut"))
    outside = rows.where(F.col("bucket").isNull() | F.col("cut").isNull() | (F.col("bucket") != F.col("cut")))
    # The rows of one bucket of a source: some 1 / PER_UNIT of them.
    order = Window.partitionBy("rank").orderBy("place", "k1", "k2", *names)
    room = (
        F.col("left")
        - F.col("before")
        - (F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    )
    some = F.greatest(F.lit(0), F.least("size", room))
    if whole:
        some = F.when(room * 2 >= F.col("size"), F.col("size")).otherwise(0)
    earlier = F.when(F.col("cut").isNull() | (F.col("bucket") < F.col("cut")), F.col("size"))
    times = F.col("times") * F.col("size")
    out = outside.withColumn("extra", F.when(F.col("bucket").isNull(), 0).otherwise(F.coalesce(earlier, F.lit(0))))
    out = out.unionByName(inside.withColumn("extra", some))
    return out.select(
        *(F.col(n).alias(k) for n, k in zip(names, keep)),
        "size",
        "source_size",
        "target",
        (times + F.col("extra")).cast("bigint").alias("taken"),
    )


def mixed_rows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scan: bool = False, **options
) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as the mix takes it, columns unchanged.

    Rows the mix leaves out go, those without words included. ``scan``: see
    :func:`covertile.llm.rows.identified`.
    """
    times = f"_times_{uuid.uuid4().hex}"
    marked, place = identified(Workspace(docs.sparkSession, "mixed"), docs, scan)
    taken = mix(marked, doc_id, text, keep={place: F.col(place)}, whole=True, **options)
    taken = taken.where("taken > 0").select(place, (F.col("taken") / F.col("size")).cast("int").alias(times))
    return (
        marked.join(taken, place)
        .withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
        .drop(place, times)
    )

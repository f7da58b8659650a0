"""Jaccard join on word shingles by grouped prefixes, and the classes its links form.

Sets. A document's set holds its distinct three-word shingles (lower-cased A-Z) as 64-bit hashes; fewer
words make one shingle. Documents with equal sets are one set from the start, known by 128 bits.

Prefixes. Two sets of sizes n and m can only reach 0.9 if the first ``n - ceil(0.9 n) + 1`` and
``m - ceil(0.9 m) + 1`` shingles in one global order have a shingle in common. The order is: rare
shingles before hot ones, then by hash. Hot ones are counted in a first run over all texts, which keeps
nothing else; their list has at most ``HOT_LIST`` entries whatever the input. Sets with the same prefix and size form a
group, and only groups meet: under each shingle of their prefixes, filtered by size and by how many
shingles can still be shared given the two positions.

Rounds. Only links that join classes are needed, so no bucket emits all its pairs. In the round of
width k the smallest member of each bucket and about k seeded others are its pivots, and pairs of a
pivot and any other member are looked at unless their classes are one already. A pair of groups is
expanded to members by the same rule: about k members of one side against all of the other. What
is left of a pair after a parity sketch (its differing bits never exceed the differing shingles) is
held against a fine one, a sixteenth to an eighth of the bytes of a set, and only what that leaves is verified
on the whole sets. Buckets whose members are all one class are closed; the width goes
from 0 to 16 and grows sixteenfold until none is open, and then every pair was verified or lies
inside one class. A crowd of near copies thus costs a star or two, not its square, and a bucket is
never held in one task.

Texts are read again for the sets to verify, so whole sets are stored only for those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from covertile.plans.workspace import Workspace

from .components import components
from .rows import identified
from .texts import WORD_HASHES, gram_hashes, words_of

SHINGLE = 3
#: A link: 10 * shared >= 9 * united.
ABOVE, BELOW = 9, 10
SKETCH = 256
#: Cells for each shingle, at least, in the sketches that sets are stored with and in those of sets to verify.
COARSE, FINE = 0.25, 4
#: A shingle in more prefixes than this is hot, unless there would be more than HOT_LIST of them.
HOT_SETS = 32
HOT_LIST = 200_000
WIDEN = 16
#: Small tables are broadcast up to so many bytes as written; beyond, both sides are shuffled.
BROADCAST_BYTES = 32 << 20
_UNIT = 1 << 20
#: What is known of all members of a group.
FAR = "struct<n: bigint, fold: array<bigint>, radius: bigint, kind: bigint>"


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = words_of(text, fold=True)
    if not words:
        return np.empty(0, np.uint64)
    hashes = WORD_HASHES.of(words)
    grams = gram_hashes(hashes, SHINGLE if len(words) >= SHINGLE else len(words))
    return np.unique(grams)


def prefix_size(n: int) -> int:
    return n - -(-ABOVE * n // BELOW) + 1 if n else 0


def prefix_of(shingles: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order (hot, hash); ``hot`` is sorted."""
    size = prefix_size(len(shingles))
    if not len(hot) or not size:
        return shingles[:size]
    at = np.minimum(np.searchsorted(hot, shingles), len(hot) - 1)
    is_hot = hot[at] == shingles
    return np.concatenate([shingles[~is_hot][:size], shingles[is_hot][:size]])[:size]


def sketch_of(shingles: np.ndarray, cells: float = COARSE) -> np.ndarray:
    """Parities of the number of shingles in each cell, packed; ``cells`` for each shingle, or more."""
    size = SKETCH
    while size < cells * len(shingles):
        size *= 2
    cells = np.bincount((shingles >> np.uint64(24)) % np.uint64(size), minlength=size)
    return np.packbits((cells & 1).astype(np.uint8), bitorder="little").view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))


_LONGS = ArrayType(LongType())


def facts(hot: np.ndarray):
    """Column function: text -> identity, size, prefix with the hot shingles last, and sketch of its set."""

    @F.arrow_udf(
        StructType(
            [StructField(n, LongType()) for n in ("k1", "k2", "n")]
            + [StructField("prefix", _LONGS), StructField("sketch", _LONGS)]
        )
    )
    def of(texts: pa.Array) -> pa.Array:
        keys, sizes, prefixes, sketches = [], [], [], []
        for text in texts:
            s = shingle_set(text.as_py())
            keys.append(xxhash.xxh3_128_digest(s.tobytes()))
            sizes.append(len(s))
            prefixes.append(prefix_of(s, hot))
            sketches.append(sketch_of(s))
        halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
        columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes, pa.int64())]
        columns += [_lists(prefixes), _lists(sketches)]
        return pa.StructArray.from_arrays(columns, ["k1", "k2", "n", "prefix", "sketch"])

    return of


@F.arrow_udf(_LONGS)
def hash_prefix(texts: pa.Array) -> pa.Array:
    """The prefixes of texts in the order by hash alone."""
    sets = (shingle_set(t.as_py()) for t in texts)
    return _lists([s[: prefix_size(len(s))] for s in sets])


@F.arrow_udf(StructType([StructField("s", _LONGS), StructField("fine", _LONGS)]))
def whole_sets(texts: pa.Array) -> pa.Array:
    sets = [shingle_set(t.as_py()) for t in texts]
    columns = [_lists(sets), _lists([sketch_of(s, FINE) for s in sets])]
    return pa.StructArray.from_arrays(columns, ["s", "fine"])


def _level(id_: Column, least: Column, among: Column) -> Column:
    """0 for the least member of a bucket, else a seeded number above 0, at most the size of the bucket."""
    drawn = (F.pmod(F.xxhash64(id_), F.lit(_UNIT)) + 1) * among / F.lit(float(_UNIT))
    return F.when(id_ == least, F.lit(0.0)).otherwise(drawn)


def _may_link(na: Column, i: Column, nb: Column, j: Column) -> Column:
    """Whether sets of these sizes with a common shingle at these places can reach the threshold."""
    shared = F.lit(1) + F.least(i, j) + F.least(na - i, nb - j) - F.lit(1)
    return (F.lit(BELOW) * F.least(na, nb) >= F.lit(ABOVE) * F.greatest(na, nb)) & (
        F.lit(ABOVE + BELOW) * shared >= F.lit(ABOVE) * (na + nb)
    )


def _texts(ws: Workspace, marked: DataFrame, place: str, text: str, sets: DataFrame, name: str) -> DataFrame:
    """(place, text, node) of the documents that stand for the sets.

    What is looked up is broadcast while it is small as written; else both sides are shuffled.
    """
    wanted = _small(ws, sets.select("node", F.col("place").alias(place)), name)
    return marked.select(place, F.col(text).alias("text")).join(wanted, place)


def _near(differ: Column, na: Column, nb: Column) -> Column:
    """Whether sets of these sizes may differ in so few shingles that they link."""
    return F.lit(ABOVE + BELOW) * differ <= F.lit(BELOW - ABOVE) * (na + nb)


def _halved(sketch: str, other: str) -> Column:
    """A sketch, folded to half its length if it is twice as long as another: its parities add up."""
    half = F.size(other)
    folded = F.zip_with(F.slice(sketch, 1, half), F.slice(sketch, half + 1, half), lambda p, q: p.bitwiseXOR(q))
    return F.when(F.size(sketch) == 2 * half, folded).otherwise(F.col(sketch))


def _differ(a: Column | str, b: Column | str) -> Column:
    """In how many bits two sketches differ.

    Sketches of different lengths are of sizes on both sides of a power of two: those pairs go on.
    """
    differ = F.aggregate(
        F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, v: total + v
    )
    return F.when(F.size(a) == F.size(b), differ).otherwise(F.lit(0))


def _folded(sketch: str) -> Column:
    """A sketch as long as the shortest: cells that fall together add up, so do their parities."""
    words = SKETCH // 64
    part = lambda j: F.filter(sketch, lambda _, i: i % words == j)
    return F.transform(
        F.sequence(F.lit(0), F.lit(words - 1)),
        lambda j: F.aggregate(part(j), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x)),
    )


def _bits(a: str, b: str) -> Column:
    """In how many bits two folded sketches differ."""
    return sum((F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(SKETCH // 64)), F.lit(0))


def _small(ws: Workspace, df: DataFrame, name: str) -> DataFrame:
    """``df`` written, to be broadcast if it is small."""
    return _sent(ws, ws.write(df, name), name)


def _sent(ws: Workspace, df: DataFrame, name: str) -> DataFrame:
    """``df``, which was written as ``name``, to be broadcast if it is small."""
    return F.broadcast(df) if ws.bytes(name) <= BROADCAST_BYTES else df


def _folds(members: DataFrame) -> DataFrame:
    """(g, fold, radius) of every group."""
    least = members.where("node = g").select("g", _folded("sketch").alias("fold"))
    others = members.where("m > 1").select("g", _folded("sketch").alias("own")).join(least, "g")
    radius = others.groupBy("g").agg(F.max(_bits("own", "fold")).alias("radius"))
    return least.join(radius, "g", "left").select("g", "fold", F.coalesce("radius", F.lit(0)).alias("radius"))


def _hot_shingles(ws: Workspace, docs: DataFrame, text: str) -> np.ndarray:
    """The shingles that come last in prefixes, sorted: at most HOT_LIST of those in more than HOT_SETS prefixes.

    Equal texts count each: which shingles are hot is a matter of cost alone.
    """
    # Written first: Python and the counting of shingles would need their memory in the same tasks.
    firsts = ws.write(docs.select(hash_prefix(F.col(text)).alias("prefix")), "firsts")
    counts = firsts.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("b"))
    common, seen = ws.measured(counts.where(F.col("b") > HOT_SETS), "common", most=F.sum("b"))
    ws.drop("firsts")
    # More than 1 / HOT_LIST of all common places: at most HOT_LIST shingles are.
    hot = common.where(F.col("b") * F.lit(HOT_LIST) > F.lit(seen["most"])) if seen["rows"] else common.limit(0)
    return np.sort(np.array([r["token"] for r in hot.select("token").collect()], np.int64).view(np.uint64))


def _groups(ws: Workspace, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, n, m, prefix) of the groups and (g, m, node, n, sketch) of their members."""
    key = [F.xxhash64("n", "prefix").alias("g1"), F.xxhash64(F.lit("second"), "n", "prefix").alias("g2")]
    keyed = sets.select("*", *key)
    shared = keyed.groupBy("g1", "g2").agg(F.min("node").alias("g"), F.count(F.lit(1)).alias("m")).where("m > 1")
    # Most groups have one member: what is joined to the sets is small, and prefixes stay where they are.
    dealt = keyed.join(ws.write(shared, "shared"), ["g1", "g2"], "left").select(
        F.coalesce("g", "node").alias("g"), F.coalesce("m", F.lit(1)).alias("m"), "node", "n", "sketch", "prefix"
    )
    members = ws.write(dealt, "members")
    return members.where("node = g").select("g", "m", "n", "prefix"), members.drop("prefix")


def _entries(ws: Workspace, groups: DataFrame) -> DataFrame:
    """(token, g, n, m, pos) of every shingle in several prefixes, with its pivot and bucket size.

    ``kind`` is the class of a group whose members are all of one, once that is known; ``fold`` is the folded
    sketch of its least member and ``radius`` how many bits other members differ from that at most.
    """
    index = groups.select("g", "n", "m", F.posexplode("prefix").alias("pos", "token"))
    counts = index.groupBy("token").agg(F.count(F.lit(1)).alias("b")).where("b > 1")
    several = ws.write(index.join(_small(ws, counts, "tokens"), "token"), "several")
    pivots = several.groupBy("token").agg(
        F.max("m").alias("widest"), F.min(F.struct("g", "n", "pos")).alias("pivot")
    )
    entries = several.join(_small(ws, pivots, "pivots"), "token")
    unknown = {
        "kind": F.lit(None).cast("bigint"), "fold": F.lit(None).cast("array<bigint>"), "radius": F.lit(0)
    }
    return ws.write(entries.withColumns(unknown), "entries")


def _group_pairs(entries: DataFrame, width: int) -> DataFrame:
    """(a, b, level, far): groups b that may hold links of the pivot group a, and when a became pivot.

    ``far`` holds what is known of all members of b: their size, fold and radius, and their class if they have one.
    """
    if not width:
        met = entries.where("g <> pivot.g").where(
            _may_link(F.col("pivot.n"), F.col("pivot.pos"), F.col("n"), F.col("pos"))
        )
        met = met.select(F.col("pivot.g").alias("a"), F.col("g").alias("b"), F.lit(0.0).alias("level")).distinct()
        return met.withColumn("far", F.lit(None).cast(FAR))
    level = _level(F.col("g"), F.col("pivot.g"), F.col("b"))
    pivots = entries.select(
        "token", F.col("g").alias("a"), F.col("n").alias("na"), F.col("pos").alias("i"), F.col("kind").alias("kind_a"),
        F.col("fold").alias("fold_a"), F.col("radius").alias("radius_a"), level.alias("level"),
    ).where(F.col("level") <= width)
    others = entries.select("token", F.col("g").alias("b"), "n", "pos", "kind", "fold", "radius")
    # Members are no nearer to each other than their least ones less what they differ from those.
    apart = F.coalesce(_bits("fold", "fold_a"), F.lit(0)) - F.col("radius") - F.col("radius_a")
    near = _near(apart, F.col("na"), F.col("n"))
    met = others.join(pivots, "token").where("a <> b AND (kind IS NULL OR kind_a IS NULL OR kind <> kind_a)")
    met = met.where(near).where(
        _may_link(F.col("na"), F.col("i"), F.col("n"), F.col("pos"))
    )
    far = F.struct("n", "fold", "radius", "kind").cast(FAR)
    return met.groupBy("a", "b").agg(F.min("level").alias("level"), F.first(far).alias("far"))


def _member_pairs(pairs: DataFrame, members: DataFrame, width: int, before: int) -> DataFrame:
    """(x, y) to verify this round: a pivot member of one group and any of the other."""
    inner = _level(F.col("node"), F.col("g"), F.col("m"))
    ours = members.select(
        F.col("g").alias("a"), F.col("node").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("sx"),
        F.col("root").alias("rx"), inner.alias("inner"), _folded("sketch").alias("fx"),
    ).where(F.col("inner") <= width)
    theirs = members.select(
        F.col("g").alias("b"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("sy"),
        F.col("root").alias("ry"),
    )
    new = F.greatest("level", "inner") > F.lit(before)
    # A member goes on to a group unless it is too far from all of it, or of its class.
    apart = _bits("far.fold", "fx") - F.col("far.radius")
    able = F.coalesce(_near(apart, F.col("nx"), F.col("far.n")), F.lit(True))
    able = able & F.coalesce(F.col("rx") != F.col("far.kind"), F.lit(True))
    return (
        pairs.join(ours, "a")
        .where(new & able)
        .join(theirs, "b")
        .where("rx <> ry")
        .where(_near(_differ("sx", "sy"), F.col("nx"), F.col("ny")))
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .distinct()
    )


def _ends(pairs: DataFrame, whole: DataFrame, *columns: str) -> DataFrame:
    """The pairs with columns of both their sets; only what the pairs name is sent."""
    end = lambda e: whole.select(F.col("node").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in columns])
    named = end("x").join(pairs.select("x"), "x", "left_semi")
    return pairs.join(end("y"), "y").join(named, "x")


def _verified(ws: Workspace, pairs: DataFrame, sets: DataFrame, marked: DataFrame, place: str, text: str, number: int) -> DataFrame:
    """The pairs that are links, by their whole sets; those that fine sketches tell apart are left out first."""
    wanted = pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct()
    named = sets.join(wanted, "node", "left_semi")
    texts = _texts(ws, marked, place, text, named, f"wanted{number}")
    whole = texts.select("node", whole_sets(F.col("text")).alias("t")).select("node", F.size("t.s").alias("n"), "t.*")
    whole = ws.write(whole, f"whole{number}")
    near = _ends(_sent(ws, pairs, f"pairs{number}"), whole, "n", "fine")
    differ = _differ(_halved("fine_x", "fine_y"), _halved("fine_y", "fine_x"))
    near = near.where(_near(differ, F.col("n_x"), F.col("n_y"))).select("x", "y")
    near = _small(ws, near, f"near{number}")
    shared = F.size(F.array_intersect("s_x", "s_y"))
    united = F.size("s_x") + F.size("s_y") - shared
    return (
        _ends(near, whole, "s")
        .where(F.lit(BELOW) * shared >= F.lit(ABOVE) * united)
        .select(F.col("x").alias("a"), F.col("y").alias("b"))
    )


def _still_open(ws: Workspace, entries: DataFrame, members: DataFrame, folds: DataFrame, width: int, number: int):
    """Entries of buckets and groups that have untested pairs of different classes."""
    spans = members.groupBy("g").agg(F.max("m").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
    alone = spans.where((F.col("m") > max(width, 2)) & (F.col("low") < F.col("high")))
    wide = (F.col("b") > width) | (F.col("widest") > width)
    if not width:
        wide = (F.col("b") > 2) | (F.col("widest") > 1)
    one = F.when(F.col("low") == F.col("high"), F.col("low")).alias("kind")
    known = _small(ws, spans.select("g", "low", "high", one), f"spans{number}")
    tagged = entries.where(wide).drop("kind", "fold", "radius").join(known, "g")
    ends = (
        tagged.groupBy("token")
        .agg(F.min("low").alias("low"), F.max("high").alias("high"))
        .where("low < high")
        .select("token")
    )
    ends = _small(ws, ends, f"open_tokens{number}")
    left = tagged.join(ends, "token", "left_semi").join(folds, "g").select(*entries.columns)
    left, seen = ws.measured(left, f"open{number}")
    ws.drop(f"open{number - 1}" if number else "entries")
    groups, several = ws.measured(alone.select("g"), f"open_groups{number}")
    return left, groups, seen["rows"] + several["rows"]


def _labels(spark, links: DataFrame) -> DataFrame:
    """(node, root) of all linked sets."""
    with Workspace(spark, "jaccard_classes") as ws:
        found = ws.write(components(ws, links), "labels")
        ws.finish("labels")
        return found


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scan: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for every document.

    The component is the smallest id reachable over links, the document's own included. Null texts and
    texts without words have no shingles and link with nothing, not even with each other: their
    component is their own id. A null id takes part but names no component unless all its ids are
    null. Repeated rows stay, and are linked if they have words. ``scan``: see
    :func:`covertile.llm.rows.identified`.
    """
    spark = docs.sparkSession
    with Workspace(spark, "jaccard") as ws:
        marked, place = identified(ws, docs, scan)
        of_text = facts(_hot_shingles(ws, marked, text))(F.col(text))
        made = ws.write(
            marked.select(F.col(doc_id).alias("id"), F.col(place).alias("place"), of_text.alias("t")).select(
                "id", "place", "t.*"
            ),
            "made",
        )
        rows = ws.write(made.select("id", "k1", "k2", "n"), "rows")
        sets = ws.write(
            made.where("n > 0")
            .groupBy("k1", "k2")
            .agg(
                F.min("id").alias("first"), F.min("place").alias("place"), F.first("n").alias("n"),
                F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"),
            )
            .withColumn("node", F.monotonically_increasing_id()),
            "sets",
        )
        ws.drop("made")
        groups, members = _groups(ws, sets)
        folds = _small(ws, _folds(members), "folds")
        entries = _entries(ws, groups)
        for stage in ("tokens", "several", "pivots"):
            ws.drop(stage)
        lone = groups.where("m > 1").select("g")
        width, before, number, links, labels = 0, -1, 0, None, None
        now = members.withColumn("root", F.col("node"))
        while True:
            within = lone.select(
                F.col("g").alias("a"), F.col("g").alias("b"), F.lit(0.0).alias("level"), F.lit(None).cast(FAR).alias("far")
            )
            pairs, seen = ws.measured(
                _member_pairs(_group_pairs(entries, width).union(within), now, width, before), f"pairs{number}"
            )
            if seen["rows"]:
                found, met = ws.measured(_verified(ws, pairs, sets, marked, place, text, number), f"links{number}")
                ws.drop(f"whole{number}")
                if met["rows"]:
                    links = found if links is None else links.union(found)
                    labels = _labels(spark, links)
                    now = members.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
            entries, lone, waiting = _still_open(ws, entries, now, folds, width, number)
            if not waiting:
                break
            before, width, number = width, WIDEN * max(width, 1), number + 1
        if labels is None:
            of_set = sets.select("k1", "k2", F.col("first").alias("component_id"))
        else:
            named = sets.join(labels, "node").select("k1", "k2", "first", "root")
            smallest = ws.write(named.groupBy("root").agg(F.min("first").alias("component_id")), "smallest")
            of_set = named.join(smallest, "root").select("k1", "k2", "component_id").union(
                sets.join(labels, "node", "left_anti").select("k1", "k2", F.col("first").alias("component_id"))
            )
        of_set = ws.write(of_set, "of_set")
        ws.finish("rows", "of_set")
        own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
        return rows.join(of_set, ["k1", "k2"], "left").select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id")
        )

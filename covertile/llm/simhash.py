"""SimHash fingerprints and near-duplicate groups found by Golay-code fuzzy hashing.

Method. A fingerprint has 64 bits and two of them are linked at ``MAX_BITS`` = 4 or fewer differing
bits. The bits are dealt into ``4 + exact_blocks`` blocks. Four errors leave at least
``exact_blocks`` blocks untouched, so for one of the choices of that many blocks the two
fingerprints agree on them exactly. The other blocks are halved into two segments of at most 23
bits; at most four errors fall into the two, so one segment has two errors or fewer. The perfect
binary Golay code decodes every 23-bit word to the one codeword within three bits. A segment is
given the codeword indices of itself and of its 23 neighbours, which are one index or six; two
words at distance two have a common neighbour, hence a common index. A key is (choice of blocks,
half, value of the exact blocks, codeword index). Every link therefore meets under some key: the
search is exact, and each meeting is verified on the whole fingerprints.

Groups. Only distinct fingerprints are compared, so exact copies cost nothing. Keys are counted
first, with map-side combination. Keys with up to ``bucket`` fingerprints are gathered and linked
by a spanning forest of their verified pairs. Fingerprints that share a larger key are linked
without any pair: each sends itself to all words within two bits (in the bits the key leaves
open); two fingerprints within four bits have such a word in common, and all that meet there are
within four bits, so a star to the smallest is exact and linear.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from covertile.plans.workspace import Workspace

from .components import components
from .rows import identified
from .texts import words_of

MAX_BITS = 4
SHINGLE = 4
SEED = 42
SEGMENT = 23
CHUNK = 1 << 16
# Crowded fingerprints a task makes words of; each gives some 1,300 of them.
TASK_CROWD = 4096
# Above this many stars the words are joined to them by shuffle instead of broadcast.
BROADCAST_STARS = 100_000


# -- fingerprints -------------------------------------------------------------------------------


def fingerprint_of(text: str | None) -> int:
    """Bits set in more than half of the XXH64 values of the text's shingles; 0 without words."""
    words = words_of(text, fold=True)
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[SHINGLE - 1 :].tolist()
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        part = h[at : at + CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """Fingerprints as signed longs."""
    out = np.fromiter((fingerprint_of(t.as_py()) for t in texts), np.uint64, len(texts))
    return pa.array(out.view(np.int64))


def hex_of(fingerprint: Column) -> Column:
    """16 lowercase hex digits of the 64 bits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# -- the code -----------------------------------------------------------------------------------

GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 of the Golay code


def _syndrome(word: int) -> int:
    for bit in range(SEGMENT - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def code_tables() -> tuple[np.ndarray, np.ndarray]:
    """(syndrome of each byte of a word, 3 x 256; neighbour codewords of a syndrome as XOR offsets).

    The second table has six columns; where all neighbours decode alike they hold one offset.
    """
    of_bit = [_syndrome(1 << i) for i in range(SEGMENT)]
    error = {0: 0}
    for weight in (1, 2, 3):
        for places in combinations(range(SEGMENT), weight):
            s = e = 0
            for p in places:
                s, e = s ^ of_bit[p], e | 1 << p
            error[s] = e
    offsets = np.zeros((1 << 11, 6), np.uint32)
    for s, e in error.items():
        near = {e} | {error[s ^ of_bit[i]] ^ 1 << i for i in range(SEGMENT)}
        offsets[s] = (sorted(near) * 6)[:6] if len(near) == 1 else sorted(near)
    bytes_ = np.zeros((3, 256), np.uint32)
    for k in range(3):
        for value in range(256):
            for i in range(8):
                if value >> i & 1 and 8 * k + i < SEGMENT:
                    bytes_[k, value] ^= of_bit[8 * k + i]
    return bytes_, offsets


def neighbour_codewords(words: np.ndarray, tables) -> np.ndarray:
    """Codeword indices near each 23-bit word, as (n, 6); repeats stand for a single index."""
    bytes_, offsets = tables
    s = bytes_[0, words & 255] ^ bytes_[1, words >> 8 & 255] ^ bytes_[2, words >> 16]
    return (words[:, None] ^ offsets[s]) >> 11


def choices(exact_blocks: int) -> list[tuple[list[int], list[int]]]:
    """(bits compared exactly, bits of one segment) for every choice of blocks and half."""
    n = MAX_BITS + exact_blocks
    blocks = [list(map(int, b)) for b in np.array_split(np.arange(64), n)]
    out = []
    for chosen in combinations(range(n), exact_blocks):
        exact = [b for i in chosen for b in blocks[i]]
        free = [b for b in range(64) if b not in exact]
        half = min(SEGMENT, len(free) // 2)
        out += [(exact, free[:half]), (exact, free[half : 2 * half])]
    return out


def gathered(x: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each word, packed to the right."""
    out = np.zeros(len(x), np.uint64)
    for place, bit in enumerate(bits):
        out |= (x >> np.uint64(bit) & np.uint64(1)) << np.uint64(place)
    return out


def fuzzy_keys(exact_blocks: int):
    """For mapInArrow: (fp) -> (fp, key)."""
    picks = choices(exact_blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = code_tables()
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            for at in range(0, len(x), CHUNK):
                part = x[at : at + CHUNK]
                for number, (exact, segment) in enumerate(picks):
                    near = neighbour_codewords(gathered(part, segment).astype(np.uint32), tables)
                    real = np.ones(near.shape, bool)
                    real[:, 1:] = near[:, 1:] != near[:, :1]
                    head = np.uint64(number) << np.uint64(48) | gathered(part, exact) << np.uint64(12)
                    key = (head[:, None] | near.astype(np.uint64))[real]
                    fp = np.broadcast_to(part[:, None], near.shape)[real]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp.view(np.int64)), pa.array(key.view(np.int64))], ["fp", "key"]
                    )

    return run


def _forest(fps: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one bucket (at most its size)."""
    waiting = np.ones(len(fps), bool)
    for start in range(len(fps)):
        if not waiting[start]:
            continue
        waiting[start] = False
        reached = [start]
        while reached:
            i = reached.pop()
            others = np.flatnonzero(waiting)
            near = others[np.bitwise_count(fps[others] ^ fps[i]) <= MAX_BITS]
            waiting[near] = False
            for j in near.tolist():
                yield i, j
            reached += near.tolist()


def bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: arrays of fingerprints that share a key -> verified links."""
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten().to_numpy().view(np.uint64)
        size = lists.value_lengths().to_numpy()
        end = np.cumsum(size)
        a, b = [], []
        two = end[size == 2]
        x, y = flat[two - 2], flat[two - 1]
        close = np.bitwise_count(x ^ y) <= MAX_BITS
        a.append(x[close])
        b.append(y[close])
        for stop, n in zip(end[size > 2].tolist(), size[size > 2].tolist()):
            fps = flat[stop - n : stop]
            pairs = np.array(list(_forest(fps)), np.int64).reshape(-1, 2)
            a.append(fps[pairs[:, 0]])
            b.append(fps[pairs[:, 1]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"]
        )


def midpoints(exact_blocks: int):
    """For mapInArrow: (fp, choice) -> (fp, word) for all words within two bits of fp.

    Only bits outside the exact blocks of the choice are changed.
    """
    flips = []
    for exact, _ in choices(exact_blocks):
        free = [np.uint64(1 << b) for b in range(64) if b not in exact]
        flips.append(np.array([0, *free, *(p | q for p, q in combinations(free, 2))], np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_numpy().view(np.uint64)
            choice = batch.column(1).to_numpy()
            for at in range(0, len(x), 256):
                part, pick = x[at : at + 256], choice[at : at + 256]
                for c in np.unique(pick):
                    fp = part[pick == c]
                    word = fp[:, None] ^ flips[c][None, :]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(fp, word.shape[1]).view(np.int64)),
                            pa.array(word.ravel().view(np.int64)),
                        ],
                        ["fp", "word"],
                    )

    return run


def links(ws: Workspace, fps: DataFrame, exact_blocks: int, bucket: int) -> DataFrame:
    """Links (a, b) of distinct fingerprints ``fp`` that keep all connections within four bits."""
    keys = fps.mapInArrow(fuzzy_keys(exact_blocks), "fp bigint, key bigint")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    large, seen = ws.measured(sizes.where(F.col("n") > bucket).select("key"), "large_keys")
    small = keys
    if seen["rows"]:
        small = keys.join(large, "key", "left_anti")
    found = (
        small.groupBy("key")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
        .mapInArrow(bucket_links, "a bigint, b bigint")
        .distinct()
    )
    if not seen["rows"]:
        return ws.write(found, "links")
    crowded = (
        keys.join(large, "key", "left_semi")
        .select("fp", F.shiftright("key", 48).cast("int").alias("choice"))
        .distinct()
    )
    # The two halves of a choice of blocks leave the same bits open: one of them will do.
    crowded = crowded.select("fp", (F.col("choice") - F.col("choice") % 2).alias("choice")).distinct()
    crowded, seen = ws.measured(crowded, "crowded")
    # The planner takes the words of a fingerprint for one row: left to it, a small table would become words in
    # one task, and be broadcast as such.
    spread = crowded.repartition(1 + seen["rows"] // TASK_CROWD, "fp")
    met = spread.mapInArrow(midpoints(exact_blocks), "fp bigint, word bigint")
    stars = met.groupBy("word").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z")
    # Written first, so that a word in which very many meet is split when they are joined to it.
    stars, seen = ws.measured(stars.select("word", "a"), "stars")
    stars = F.broadcast(stars) if seen["rows"] <= BROADCAST_STARS else stars.hint("merge")
    # A word links all that meet at it to the smallest; each fingerprint keeps its links once.
    linked = (
        met.join(stars, "word")
        .where("fp > a")
        .select("a", F.col("fp").alias("b"))
        .distinct()
    )
    return ws.write(found.union(linked).distinct(), "links")


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    exact_blocks: int = 1,
    bucket: int = 512,
) -> DataFrame:
    """One row per document: ``doc_id``, ``fp`` (signed long), ``component_id``.

    The component is the smallest id reachable over links of at most four differing bits, the
    document's own included. Null and wordless texts have fingerprint zero and link like any
    other. A null id takes part but does not name a component unless all its ids are null.
    Repeated rows stay. ``exact_blocks=2`` has three times as many keys and meets a hundred times
    fewer strangers: take it from some 100 million distinct fingerprints on. Results are the same.
    ``bucket`` bounds what one task gathers for a key and leaves results alone too.
    """
    ws = Workspace(docs.sparkSession, "simhash")
    made = docs.select(F.col(doc_id).alias("id"), fingerprints(F.col(text)).alias("fp"))
    made = ws.write(made, "fingerprints")
    fps = ws.write(made.groupBy("fp").agg(F.min("id").alias("first")), "distinct")
    group = components(ws, links(ws, fps.select("fp"), exact_blocks, bucket))
    named = (
        fps.join(group, fps.fp == group.node, "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    )
    smallest = (
        named.groupBy("root")
        .agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("component_id"))
        .where("n > 1")
        .drop("n")
    )
    # Written first, so that a large group is split when its fingerprints are joined to it; a group of one
    # fingerprint knows its smallest id.
    smallest = ws.write(smallest, "smallest").withColumn("several", F.lit(True))
    of_fp = named.join(smallest, "root", "left").select(
        "fp", F.when(F.col("several"), F.col("component_id")).otherwise(F.col("first")).alias("component_id")
    )
    return made.join(of_fp, "fp").select(
        F.col("id").alias("doc_id"), "fp", "component_id"
    )


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", scan: bool = False, **options
) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: the smallest id of each group stays.

    Repeated rows of that id count as copies of each other, so one of them stays; null is smaller
    than any id. Columns are those of ``docs``, whatever their names. ``scan``: see
    :func:`covertile.llm.rows.identified`.
    """
    inner = "_place"
    marked, place = identified(Workspace(docs.sparkSession, "near_dedup"), docs, scan)
    groups = near_duplicates(
        marked.select(F.struct(F.col(doc_id).alias("id"), F.col(place).alias(inner)).alias("doc_id"), F.col(text).alias("text")),
        **options,
    )
    kept = groups.where(F.col(f"doc_id.{inner}") == F.col(f"component_id.{inner}"))
    return marked.join(
        kept.select(F.col(f"doc_id.{inner}").alias(place)), place, "left_semi"
    ).drop(place)

"""Importance resampling towards a target distribution.

Every run of one to three consecutive words is a feature, hashed into ``BUCKETS`` buckets. A bucket's
gain is the logarithm of how much commoner it is in the target texts than in all documents, in
thousandths and rounded down; a document's weight is the sum of the gains of its features. Adding
seeded Gumbel noise to the weights and taking the highest scores draws documents without replacement
in proportion to their importance.

Method. The gains are an array of ``BUCKETS`` numbers, which is all the driver and the tasks hold of
the corpus; a text is scored by indexing that array with the buckets of its features. The checksums
of runs follow from those of their words, as a checksum is linear: the checksum of ``a`` followed by
``b`` is that of ``a`` moved on by the length of ``b``, combined with that of ``b``. The cutoff is found
without sorting the scores: a mergeable quantile sketch brackets it, one exact count of the rows above
and inside the bracket says whether it holds the cutoff, or the bracket is widened on the side that
failed; only the rows inside are sorted, over range partitions. Ranks of the drawn rows go over
range partitions too. Scores are written once, so that all passes see the same rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from covertile.plans.ranks import ranked
from covertile.plans.workspace import Workspace

BUCKETS = 10_000
RUN = 3
LEAST_WORDS = 20
PER_CENT = 5
SEED = 42
#: Quantiles the sketch is asked for lie this far to both sides of the cutoff, doubled when it misses.
MARGIN = 0.001
ACCURACY = 10_000
#: Words longer than this are hashed with their neighbours one by one, not by table.
LONGEST = 255
KEPT_WORDS = 200_000

# Everything but digits, letters and bytes beyond ASCII parts words; A-Z become a-z.
_FOLD = bytes(
    b if b >= 128 or chr(b).isdigit() or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split() if text else []


def _moves() -> np.ndarray:
    """moves[n, k, v]: what byte ``k`` = ``v`` of a checksum turns into when n bytes follow."""
    out = np.zeros((2 * LONGEST + 2, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    # One zero byte more: shift the register and feed the byte that leaves it back in.
    feed = np.array(
        [zlib.crc32(bytes([v]), 0xFFFFFFFF) ^ 0xFFFFFFFF for v in range(256)], np.uint32
    )
    for n in range(1, len(out)):
        last = out[n - 1]
        out[n] = (last >> np.uint32(8)) ^ feed[last & np.uint32(255)]
    return out


class Words(dict):
    """word -> its number; by number its checksum, that with a space ahead, its length. Emptied when full."""

    def __init__(self):
        self.moves = _moves()
        self._reset()

    def _reset(self):
        self.clear()
        self.crc = np.zeros(1024, np.uint32)
        self.ahead = np.zeros(1024, np.uint32)
        self.size = np.zeros(1024, np.int64)

    def __missing__(self, word: bytes) -> int:
        at = len(self)
        if at == len(self.crc):
            for name in ("crc", "ahead", "size"):
                setattr(self, name, np.resize(getattr(self, name), 2 * at))
        self[word] = at
        self.crc[at], self.ahead[at], self.size[at] = zlib.crc32(word), zlib.crc32(b" " + word), len(word)
        return at

    def joined(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Checksums of texts with checksums ``a`` followed by texts of ``size`` with ``b``."""
        m = self.moves
        low = np.uint32(255)
        out = b ^ m[size, 0, a & low]
        out ^= m[size, 1, a >> np.uint32(8) & low]
        out ^= m[size, 2, a >> np.uint32(16) & low]
        return out ^ m[size, 3, a >> np.uint32(24)]

    def buckets(self, words: list[bytes]) -> np.ndarray:
        """The buckets of all runs of one to ``RUN`` words."""
        if len(self) >= KEPT_WORDS:
            self._reset()
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        crc, ahead, size = self.crc[ids], self.ahead[ids], self.size[ids]
        if not len(ids):
            return np.empty(0, np.int64)
        if size.max() > LONGEST:
            runs = [
                zlib.crc32(b" ".join(words[i : i + n]))
                for n in range(1, RUN + 1)
                for i in range(len(words) - n + 1)
            ]
            return np.array(runs, np.int64) % BUCKETS
        two = self.joined(crc[:-1], ahead[1:], size[1:] + 1)
        three = self.joined(two[:-1], ahead[2:], size[2:] + 1)
        return np.concatenate([crc, two, three]).astype(np.int64) % BUCKETS


_words: list[Words] = []


def buckets_of(text: str | None) -> np.ndarray:
    """Buckets of a text's features, repeats included."""
    if not _words:
        _words.append(Words())
    return _words[0].buckets(words_of(text))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: texts -> one row of counts for each bucket met in the task."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            total += np.bincount(buckets_of(text.as_py()), minlength=BUCKETS)
    met = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])


def bucket_counts(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts of a table."""
    found = texts.select(text).mapInArrow(_counted, "bucket bigint, n bigint")
    out = np.zeros(BUCKETS, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of target and source frequency, each count raised by one."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array(
        [
            math.floor(1000.0 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
            for s, t in zip(source.tolist(), target.tolist())
        ],
        np.int64,
    )


def weigher(gains: np.ndarray):
    """Column function: text -> (n_words, n_features, weight)."""
    names = ("n_words", "n_features", "weight")

    @F.arrow_udf(StructType([StructField(n, LongType()) for n in names]))
    def weigh(texts: pa.Array) -> pa.Array:
        rows = np.zeros((len(texts), 3), np.int64)
        for i, text in enumerate(texts):
            b = buckets_of(text.as_py())
            # n words have n + (n - 1) + (n - 2) features; fewer than three words have less.
            n = len(b)
            rows[i] = (n + 3) // 3 if n >= 3 else n, n, gains[b].sum()
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], list(names))

    return weigh


def noise(doc_id, seed: int = SEED):
    """Gumbel noise of an id in thousandths, rounded down; a null id is taken as no digits."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def cutoff(ws: Workspace, scored: DataFrame, rows: int, wanted: int, margin: float = MARGIN):
    """The (score, id) of the row that is number ``wanted`` from the top of ``scored``.

    ``scored`` has ``rows`` >= ``wanted`` >= 1 rows. Equal scores go to smaller ids, null first.
    """
    at, low_margin, high_margin, number = 1.0 - wanted / rows, margin, margin, 0
    while True:
        number += 1
        ends = [max(0.0, at - low_margin), min(1.0, at + high_margin)]
        low, high = scored.agg(F.percentile_approx("score", ends, ACCURACY).alias("q")).first()["q"]
        inside = F.col("score").between(low, high)
        # An end of the whole range is open: the sketch promises ranks, not the extremes.
        if ends[0] == 0.0:
            inside = F.col("score") <= high
        if ends[1] == 1.0:
            inside = F.col("score") >= low if ends[0] > 0.0 else F.lit(True)
        seen = scored.agg(
            F.count_if(inside).alias("inside"), F.count_if((F.col("score") > high) & ~inside).alias("above")
        ).first()
        if seen["above"] < wanted <= seen["above"] + seen["inside"]:
            break
        if seen["above"] >= wanted:
            high_margin *= 2
        else:
            low_margin *= 2
    order = [F.col("score").desc(), F.col("id")]
    placed = ranked(ws, scored.where(inside).select("score", "id"), [], order, f"bracket{number}", "place")
    found = placed.where(F.col("place") == wanted - seen["above"]).first()
    ws.drop(f"bracket{number}")
    return found["score"], found["id"]


def resample(
    docs: DataFrame,
    target: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    per_cent: int = PER_CENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    margin: float = MARGIN,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), a row for every document.

    ``rank`` counts the drawn documents from 1 by falling score, ties to the smaller id; it is null for
    the others. ``per_cent`` of the documents of ``least_words`` words or more are drawn, rounded down.
    Null and empty texts have no features and weight 0. A null id comes before all others in ties;
    rows that are equal in id and score are ranked by weight and features, and are the same row to the result
    beyond that. Empty tables give empty results; an empty target counts each bucket once.
    """
    with Workspace(docs.sparkSession, "resample") as ws:
        gains = gains_of(bucket_counts(docs, text), bucket_counts(target, target_text))
        scored, seen = ws.measured(
            docs.select(F.col(doc_id).alias("id"), weigher(gains)(F.col(text)).alias("t"))
            .select("id", "t.*", (F.col("t.weight") + noise(F.col("id"), seed)).alias("score")),
            "scored",
            able=F.count_if(F.col("n_words") >= least_words),
        )
        columns = [F.col("id").alias("doc_id"), "n_features", "weight", "score"]
        wanted = per_cent * seen["able"] // 100
        undrawn = F.lit(None).cast("bigint").alias("rank")
        if not wanted:
            return scored.select(*columns, undrawn)
        able = F.col("n_words") >= least_words
        score, last = cutoff(ws, scored.where(able), seen["able"], wanted, margin)
        ahead = F.col("id").isNull() if last is None else F.col("id").isNull() | (F.col("id") <= last)
        drawn = able & ((F.col("score") > score) | ((F.col("score") == score) & ahead))
        order = [F.col("score").desc(), F.col("id"), F.col("weight"), F.col("n_features")]
        places = ranked(ws, scored.where(drawn), [], order, "drawn", "rank")
        rank = F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank")
        ws.finish("scored", "drawn")
        return places.select(*columns, rank).union(scored.where(~drawn).select(*columns, undrawn))

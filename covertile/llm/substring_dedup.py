"""Substring deduplication: suffix automata of reference shards find spans that occurred earlier.

A window is ``LENGTH`` consecutive words. A word goes if some window over it has the same words as a
window that starts earlier (smaller id, or same document and earlier start). Streaming every document
through the automata of all others would be quadratic, so anchors route it:

1. The anchor of a window is its smallest run of ``GRAM`` words by hash (the leftmost of equals), so
   equal windows have equal anchors at the same offset. Neighbouring windows share anchors: a document
   becomes some n / 8 segments, each the words of the windows of one anchor.
2. Segments meet by anchor. An anchor met once has no repeats. A segment with the same words as an
   earlier one is a repeat as a whole. What remains are distinct contexts of an anchor, which may share
   some windows: only these need to be compared word by word.
3. Contexts are fetched and dealt to shards of about ``SHARD`` contexts. A shard is processed in the
   order of the corpus: a context runs through the suffix automaton of all earlier ones, the matching
   statistics give its maximal spans of ``LENGTH`` words or more, and it is then added to the
   automaton as reference. Spans are removed.

Hot anchors. Anchors that a hashed sample shows to be frequent are met by (anchor, segment, salt of the
document), so a segment comes out once for each salt, and its shard finds the repeats among those;
the sample only chooses the plan. Anchors with too many contexts for a shard are dealt by context,
and windows that are new in their shard then meet by a 128-bit hash of their words, of which all but
the first go. So neither needs an anchor in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from covertile.plans.workspace import Workspace

from .texts import WORD_HASHES, gram_hashes, mixed, words_of

LENGTH = 20
GRAM = 5
SHARD = 2_000
HOT_ROWS = 200_000
SAMPLE = 64
SALTS = 64

_BASE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
_INVERSE = np.array([pow(int(b), -1, 1 << 64) for b in _BASE], np.uint64)


class SpanHashes:
    """Hashes of any runs of a text's words, from one pass: sums of word hash times power."""

    def __init__(self, hashes: np.ndarray, base: int = 0):
        n = len(hashes) + 1
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(n, _BASE[base]))
            self.sums = np.zeros(n, np.uint64)
            np.cumsum(hashes * power[:-1], out=self.sums[1:])
            self.back = np.cumprod(np.full(n, _INVERSE[base]))

    def of(self, start: np.ndarray, stop: np.ndarray, also: np.ndarray | int = 0) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self.sums[stop] - self.sums[start]) * self.back[start]
            size = (stop - start).astype(np.uint64) * np.uint64(64) + np.asarray(also, np.uint64)
            return mixed(x ^ (size * _BASE[1]))


def segments(hashes: np.ndarray):
    """(anchor, hash of the segment, first window, number of windows) of each segment of a text."""
    grams = gram_hashes(hashes, GRAM)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span < LENGTH - GRAM + 1:  # 16 grams in a window, so the span doubles
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    place = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, len(place)))
    at = place[first]
    content = SpanHashes(hashes).of(first, first + count + LENGTH - 1, at - first)
    return grams[at], content, first, count


def _segment_rows(hot: np.ndarray):
    """For mapInArrow: (id, key, text) -> a row for each segment; ``hot`` are anchors, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for doc, key, text in zip(*(c for c in batch.columns)):
                words = words_of(text.as_py())
                if len(words) < LENGTH:
                    continue
                anchor, content, first, count = segments(WORD_HASHES.of(words))
                n = len(anchor)
                out.append((anchor, content, np.full(n, doc.as_py()), np.full(n, key.as_py()), first, count))
                held += n
                if held > 1 << 17:
                    yield rows(out)
                    out, held = [], 0
            if out:
                yield rows(out)

    def rows(out: list[tuple]) -> pa.RecordBatch:
        a, s, d, k, f, n = (np.concatenate(c) for c in zip(*out))
        a = a.view(np.int64)
        arrays = [a, s.view(np.int64), d, k, f.astype(np.int32), n.astype(np.int32), np.isin(a, hot)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], _NAMES)

    return run


_NAMES = ["anchor", "segment", "id", "key", "start", "n", "hot"]
_SEGMENT = "anchor bigint, segment bigint, id bigint, key bigint, start int, n int, hot boolean"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over rows sorted by (anchor, id, key, start): repeats and contexts.

    Adds ``kind``: 0 for a segment whose words were met before, 1 for the first of each of several
    contexts. Anchors met once give nothing; memory holds the contexts of one anchor. A segment of the
    same place as the one before is that of an equal row, which is judged as a whole, and is passed over.
    """
    anchor, seen, waiting, place = None, set(), None, None
    for batch in batches:
        a = batch.column(0).to_numpy()
        same = np.zeros(len(a) + 1, bool)
        same[1:-1] = a[1:] == a[:-1]
        # Rows alone with their anchor need no look, but the last may have others to come, and those
        # of a hot anchor have others elsewhere.
        look = same[:-1] | same[1:] | batch.column(6).to_numpy(zero_copy_only=False)
        if len(a):
            look[0] |= a[0] == anchor
            look[-1] = True
        index = np.flatnonzero(look)
        rows = list(zip(*(c.take(pa.array(index)).to_pylist() for c in batch.columns)))
        out: list[tuple] = []
        for row in rows:
            if row[0] == anchor and row[2:5] == place:
                continue
            place = row[2:5]
            if row[0] != anchor:
                anchor, seen, waiting = row[0], {row[1]}, row
                if row[6]:  # other contexts of a hot anchor are elsewhere
                    out.append((*row, 1))
                    waiting = None
            elif row[1] in seen:
                out.append((*row, 0))
            else:
                seen.add(row[1])
                if waiting:
                    out.append((*waiting, 1))
                    waiting = None
                out.append((*row, 1))
        if out:
            types = [pa.int64()] * 4 + [pa.int32(), pa.int32(), pa.bool_(), pa.int32()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays(columns, [*_NAMES, "kind"])


class SuffixAutomaton:
    """Suffix automaton over word numbers; sequences are set apart by numbers of their own."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.last = 0
        self.breaks = 0

    def _extend(self, word: int) -> None:
        new = len(self.next)
        self.next.append({})
        self.length.append(self.length[self.last] + 1)
        self.link.append(0)
        at = self.last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            if self.length[at] + 1 == self.length[to]:
                self.link[new] = to
            else:
                copy = len(self.next)
                self.next.append(dict(self.next[to]))
                self.length.append(self.length[at] + 1)
                self.link.append(self.link[to])
                while at >= 0 and self.next[at].get(word) == to:
                    self.next[at][word] = copy
                    at = self.link[at]
                self.link[to] = self.link[new] = copy
        self.last = new

    def add(self, words: list[int]) -> None:
        for w in words:
            self._extend(w)
        self.breaks -= 1
        self._extend(self.breaks)

    def matching(self, words: list[int]) -> list[int]:
        """For each place, how many words up to there are a run of what was added."""
        state = size = 0
        out = []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if w in self.next[state]:
                state, size = self.next[state][w], size + 1
            else:
                size = 0
            out.append(size)
        return out


_FOUND = "id bigint, key bigint, start int, n int, mask int, new array<struct<at:int,w1:bigint,w2:bigint>>"


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard: contexts in corpus order against the automaton of the earlier ones."""
    rows = rows.sort_values(["id", "key", "start"])
    automaton, numbers = SuffixAutomaton(), {}
    mask, new = [], []
    for text, hot in zip(rows["words"], rows["hot"]):
        raw = text.encode("utf-8").split(b" ")
        words = [numbers.setdefault(w, len(numbers)) for w in raw]
        sizes = automaton.matching(words)[LENGTH - 1 :]
        repeated = [s >= LENGTH for s in sizes]
        mask.append(sum(1 << i for i, r in enumerate(repeated) if r))
        if not all(repeated):
            automaton.add(words)
        fresh = None
        if hot:
            at = np.flatnonzero(~np.array(repeated))
            hashes = WORD_HASHES.of(raw)
            w1, w2 = (SpanHashes(hashes, b).of(at, at + LENGTH).view(np.int64) for b in (0, 1))
            fresh = [{"at": int(i), "w1": int(x), "w2": int(y)} for i, x, y in zip(at, w1, w2)]
        new.append(fresh)
    return pd.DataFrame(
        {"id": rows["id"], "key": rows["key"], "start": rows["start"], "n": rows["n"], "mask": mask, "new": new}
    )


_WORDS = "shard bigint, hot boolean, id bigint, key bigint, start int, n int, words string"


def _context_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (id, key, text, contexts) -> a row with its words for each context."""
    names = ["shard", "hot", "id", "key", "start", "n", "words"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]
    for batch in batches:
        out = []
        for doc, key, text, contexts in zip(*(c for c in batch.columns)):
            words = words_of(text.as_py())
            for c in contexts.as_py():
                part = words[c["start"] : c["start"] + c["n"] + LENGTH - 1]
                row = (c["shard"], c["hot"], doc.as_py(), key.as_py(), c["start"], c["n"])
                out.append((*row, b" ".join(part).decode("utf-8")))
        columns = zip(*out) if out else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


_RESULT = StructType(
    [StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())]
)


@F.arrow_udf(_RESULT)
def _removed(texts: pa.Array, starts: pa.Array, masks: pa.Array, copies: pa.Array) -> pa.Array:
    rows = []
    for text, start, mask, copy in zip(texts, starts, masks, copies.to_pylist()):
        words = words_of(text.as_py())
        n = len(words)
        if copy > 1 and n >= LENGTH:
            rows.append(("", n, n))
            continue
        windows = np.zeros(n + 1, np.int32)
        for s, m in zip(start.as_py() or (), mask.as_py() or ()):
            while m:
                low = (m & -m).bit_length() - 1
                windows[s + low] = 1
                m &= m - 1
        at = np.flatnonzero(windows)
        edges = np.zeros(n + 1, np.int32)
        edges[at] += 1
        np.subtract.at(edges, at + LENGTH, 1) if len(at) else None
        keep = np.cumsum(edges)[:n] == 0
        kept = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
        rows.append((b" ".join(kept).decode("utf-8"), n, n - len(kept)))
    columns = zip(*rows) if rows else [[]] * 3
    types = (pa.string(), pa.int64(), pa.int64())
    return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], _RESULT.names)


def drop_repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, kept, n_words, n_removed``: words outside repeated spans, joined by a space.

    Null texts are empty; texts of fewer than ``LENGTH`` words stay. A null id comes before all others,
    rows that share an id come in an order of their own, and a row equal to another in id and text is
    its repeat. Windows are judged on the input, not on what is left.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "spans")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        # Null ids sort first; the key keeps them apart from the smallest number.
        F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))).alias("id"),
        F.xxhash64(F.col(doc_id), F.col(text), F.col(doc_id).isNull()).alias("key"),
        F.col(text).alias("text"),
    )
    source = rows.select("id", "key", "text")
    drawn = source.where(F.pmod("key", F.lit(SAMPLE)) == 0)
    drawn = drawn.mapInArrow(_segment_rows(np.empty(0, np.int64)), _SEGMENT)
    # At most all segments / HOT_ROWS numbers.
    frequent = drawn.groupBy("anchor").count().where(F.col("count") * SAMPLE > HOT_ROWS).collect()
    hot = np.sort(np.array([r.anchor for r in frequent], np.int64))
    found = source.mapInArrow(_segment_rows(hot), _SEGMENT)
    salt = F.when(F.col("hot"), F.xxhash64("segment", F.pmod("key", F.lit(SALTS)))).otherwise(0)
    met = (
        found.repartition("anchor", salt)
        .sortWithinPartitions("anchor", "id", "key", "start")
        .mapInArrow(_meet, _SEGMENT + ", kind int")
    )
    met, seen = ws.measured(met, "met", contexts=F.sum("kind"))
    repeats = met.where("kind = 0").select("id", "key", "start", F.expr("shiftleft(1, n) - 1").alias("mask"))
    contexts = met.where("kind = 1").drop("kind")
    parts = [repeats]
    if seen["contexts"]:
        shards = -(-seen["contexts"] // SHARD)
        many = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("of_anchor"))
        # At most contexts / SHARD rows, written so that contexts of one anchor may be split against them.
        many = ws.write(many.where(F.col("of_anchor") > SHARD), "many")
        dealt = contexts.join(many, "anchor", "left").withColumn(
            "hot", F.col("hot") | F.col("of_anchor").isNotNull()
        )
        by = F.when(F.col("hot"), F.xxhash64("anchor", "segment")).otherwise(F.xxhash64("anchor"))
        dealt = dealt.withColumn("shard", F.pmod(by, F.lit(shards)))
        listed = dealt.groupBy("id", "key").agg(F.collect_list(F.struct("shard", "hot", "start", "n")).alias("contexts"))
        # The contexts of equal rows go to the shards once.
        words = source.join(listed, ["id", "key"]).dropDuplicates(["id", "key"]).mapInArrow(_context_words, _WORDS)
        judged = ws.write(words.groupBy("shard").applyInPandas(_shard, _FOUND), "judged")
        parts.append(judged.where("mask <> 0").select("id", "key", "start", "mask"))
        fresh = judged.where("new IS NOT NULL").select("id", "key", "start", F.inline("new"))
        fresh = fresh.select("id", "key", (F.col("start") + F.col("at")).alias("start"), "w1", "w2")
        firsts = fresh.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("id", "key", "start")).alias("first"))
        firsts = ws.write(firsts.where("k > 1"), "firsts")
        again = fresh.join(firsts, ["w1", "w2"]).where(
            F.struct("id", "key", "start") != F.col("first")
        )
        parts.append(again.select("id", "key", "start", F.lit(1).alias("mask")))
    gone = parts[0]
    for p in parts[1:]:
        gone = gone.union(p)
    gone = gone.groupBy("id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"))
    copy = F.row_number().over(Window.partitionBy("id", "key").orderBy(F.lit(1)))
    joined = rows.join(gone, ["id", "key"], "left").withColumn("copy", copy)
    return joined.select("doc_id", _removed("text", "starts", "masks", "copy").alias("r")).select("doc_id", "r.*")

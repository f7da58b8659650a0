"""Benchmark decontamination by size-partitioned MinHash containment search.

A document is contaminated by a test item if it contains at least ``threshold`` of the item's
distinct five-word shingles. Similarity of whole sets is useless for that (a short item inside a
long document has a tiny Jaccard similarity), so documents are partitioned by size and every
partition has its own MinHash with as many bins as its sizes need: partition c holds documents of
up to ``2^c`` shingles and splits the hash range into ``8 * 2^c`` bins, whose minima are the
signature. Both sides use the bins of the document's partition, and one equal minimum makes a
candidate. In a full partition a shingle of the document is the minimum of its bin with probability
over 0.94, and an item shares at least 0.8 of its shingles; an item of ten shingles or more is
missed with probability below 1e-9. Items with fewer are their own partition with one bin for each
hash value, so nothing is missed. Candidates are verified on the shingles themselves.

Items go to the tasks in blocks of bounded size, and all blocks are looked up in one pass over the
documents, without a shuffle. Words are runs of characters other than ASCII white space and
punctuation, with A-Z lower-cased.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .texts import WORD_HASHES, gram_hashes

SHINGLE = 5
THRESHOLD = 0.8
BINS_PER_SHINGLE = 3  # as a power of two
SMALL = 10
CLASSES = range(4, 41)
BLOCK_WORDS = 2_000_000

_FOLD = bytes(
    32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b + 32 if 65 <= b <= 90 else b
    for b in range(256)
)

MATCHES = ArrayType(
    StructType(
        [StructField(n, LongType()) for n in ("item_id", "shared", "item_shingles")]
    )
)
_ARROW = pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "shared", "item_shingles")]))


def folded_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8").translate(_FOLD).split() if text else []


def shingle_set(words: list[bytes]) -> set[bytes]:
    return {b" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


def item_shingles(words: list[bytes]) -> set[bytes]:
    """The shingles of a test item; one of fewer words is a single shingle of its own length."""
    return shingle_set(words) if len(words) >= SHINGLE else {b" ".join(words)} if words else set()


def size_class(n: int) -> int:
    """The smallest c with n <= 2^c."""
    return max(CLASSES.start, (n - 1).bit_length())


def signature(sorted_hashes: np.ndarray, c: int) -> np.ndarray:
    """The minimum of every bin that is not empty, for partition ``c``."""
    bins = sorted_hashes >> np.uint64(64 - BINS_PER_SHINGLE - c)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    return sorted_hashes[first]


class _Values:
    """Hash values with the items that have them; a bitmap turns most strangers away."""

    def __init__(self, rows: list[tuple[int, int]]):
        rows.sort()
        self.values = np.array([v for v, _ in rows], np.uint64)
        self.owners = np.array([o for _, o in rows], np.int64)
        self.map = np.zeros(1 << 20, bool)
        self.map[self.values >> np.uint64(44)] = True

    def owners_of(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes[self.map[hashes >> np.uint64(44)]]
        low, high = np.searchsorted(self.values, h), np.searchsorted(self.values, h, "right")
        hit = high > low
        found = [self.owners[a:b] for a, b in zip(low[hit], high[hit])]
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


class ItemIndex:
    """The signatures of one block of items for every size partition, made on first use."""

    def __init__(self, items: list[tuple[int, str]], threshold: float):
        self.items = []
        # Items below a shingle, by their number of words: they are looked up as they are.
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for item_id, text in items:
            words = folded_words(text)
            shingles = item_shingles(words)
            if shingles and len(words) < SHINGLE:
                self.short.setdefault(len(words), {}).setdefault(b" ".join(words), []).append(item_id)
            elif shingles:
                need = max(1, math.ceil(threshold * len(shingles) - 1e-9))
                self.items.append((item_id, shingles, need))
        self._hashes = None
        self._partitions: dict[int, _Values] = {}

    def _sorted(self) -> list[np.ndarray]:
        if self._hashes is None:
            self._hashes = [
                np.unique(np.concatenate([gram_hashes(WORD_HASHES.of(s.split(b" ")), SHINGLE) for s in x]))
                for _, x, _ in self.items
            ]
        return self._hashes

    def partition(self, c: int | None) -> _Values:
        """Signatures for size partition ``c``; None: all hashes of the small items."""
        if c not in self._partitions:
            rows = []
            for i, h in enumerate(self._sorted()):
                if (len(h) < SMALL) == (c is None):
                    rows += [(int(v), i) for v in (h if c is None else signature(h, c))]
            self._partitions[c] = _Values(rows)
        return self._partitions[c]

    def find(self, text: str | None) -> list[tuple[int, int, int]]:
        words = folded_words(text)
        out = [
            (item_id, 1, 1)
            for n, named in self.short.items()
            for run in {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} & named.keys()
            for item_id in named[run]
        ]
        if len(words) < SHINGLE or not self.items:
            return out
        h = gram_hashes(WORD_HASHES.of(words), SHINGLE)
        small = self.partition(None).owners_of(h)
        h.sort()
        c = size_class(len(h))
        met = np.union1d(small, self.partition(c).owners_of(signature(h, c)))
        if not len(met):
            return out
        own = shingle_set(words)
        for i in met.tolist():
            item_id, shingles, need = self.items[i]
            shared = len(shingles & own)
            if shared >= need:
                out.append((item_id, shared, len(shingles)))
        return out


def _search(index: ItemIndex):
    @F.arrow_udf(MATCHES)
    def found(texts: pa.Array) -> pa.Array:
        names = ("item_id", "shared", "item_shingles")
        rows = [[dict(zip(names, m)) for m in index.find(t.as_py())] for t in texts]
        return pa.array(rows, _ARROW)

    return found


def contamination(
    docs: DataFrame,
    items: DataFrame,
    column: str = "matches",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with ``column``: the items each row contains, by item id.

    An array of ``item_id, shared, item_shingles``, empty for clean rows and for null or empty
    texts. An item of one to four words is one shingle, found where its words stand in a row. Items without
    words or with a null id or text never match; repeated items match on their own. Rows and other columns stay as they are. Items are
    read to the driver in blocks of about ``BLOCK_WORDS`` words.
    """
    items = items.select(F.col(item_id).cast("bigint").alias("id"), F.col(item_text).alias("text"))
    items = items.where("id IS NOT NULL AND text IS NOT NULL")
    words = items.agg(F.sum(F.size(F.split("text", "[\\s\\p{Punct}]+")))).first()[0] or 0
    blocks = -(-words // BLOCK_WORDS)
    parts = []
    out = docs
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)
        index = ItemIndex([tuple(r) for r in block.collect()], threshold)
        parts.append(f"_block_{uuid.uuid4().hex}")
        out = out.withColumn(parts[-1], _search(index)(F.col(text)))
    if not parts:
        none = F.lit(None).cast(MATCHES)
        return docs.select(*_others(docs, column), F.coalesce(none, F.array().cast(MATCHES)).alias(column))
    both = F.array_sort(F.concat(*parts))
    return out.select(*_others(docs, column), both.alias(column))


def _others(docs: DataFrame, column: str) -> list[str]:
    return [f"`{c}`" for c in docs.columns if c != column]


def clean(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns."""
    found = f"_matches_{uuid.uuid4().hex}"
    return contamination(docs, items, found, **options).where(F.size(found) == 0).drop(found)

"""License scans: MinHash bands over overlapping text windows retrieve templates, shingles verify.

Templates are grouped by size: class w holds those of more than w/2 and up to w five-word shingles. For
each class a text is cut into blocks of w shingles, and windows are two neighbouring blocks, so a
passage as long as a template lies whole in some window, wherever it starts. A window that holds
``THRESHOLD`` of a template's shingles then has a known least Jaccard similarity to it, and the bands
are set so that such a pair shares a band with probability ``COLLIDES`` or more. Shared bands make
candidates; a candidate counts if the window contains enough of the template's distinct shingles
exactly, and gives its span in words.

All permutations of a text's shingle hashes are taken once and reduced to block minima for every
class; the minimum over a window is that of its two blocks. Templates go to the tasks in blocks of
bounded size, and documents are read once and not shuffled.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .decontaminate import SHINGLE, folded_words, shingle_set
from .texts import WORD_HASHES, gram_hashes

THRESHOLD = 0.8
COLLIDES = 0.9999
MAX_HASHES = 64
BLOCK_WORDS = 500_000
CHUNK = 1 << 14

# Notices in common use.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT '
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD conditions": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ),
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation"
    ),
    "MIT": "Released under the MIT License.",
    "MIT permission": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        'and associated documentation files (the "Software"), to deal in the Software without '
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def window_class(shingles: int) -> int:
    """Block length w, a power of two, for a template of so many shingles."""
    return 1 << (shingles - 1).bit_length()


def least_shared(shingles: int, threshold: float = THRESHOLD) -> int:
    return max(1, math.ceil(threshold * shingles - 1e-9))


def least_jaccard(w: int, threshold: float = THRESHOLD) -> float:
    """The smallest similarity of a window of class ``w`` to a template it contains."""
    return min(
        s / (m + 2 * w - s) for m in range(w // 2 + 1, w + 1) for s in [least_shared(m, threshold)]
    )


def bands(similarity: float, collides: float = COLLIDES) -> tuple[int, int]:
    """(bands, rows) with 1 - (1 - s^rows)^bands >= collides, with as many rows as hashes allow."""
    best = None
    for rows in range(1, 5):
        hit = min(similarity**rows, 1 - 1e-12)
        n = math.ceil(math.log(1 - collides) / math.log(1 - hit))
        if best is None or n * rows <= MAX_HASHES:
            best = (n, rows)
    return best


_SEED = np.array([(0xD6E8FEB86659FD93 * (k + 1)) % (1 << 64) for k in range(1024)], np.uint64)
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) | 1 for k in range(1024)], np.uint64)


def permuted(h: np.ndarray, n: int) -> np.ndarray:
    """The first n permutations of 64-bit hashes, one in each row."""
    x = h[None, :] ^ _SEED[:n, None]
    x *= _ODD[:n, None]
    x ^= x >> np.uint64(32)
    return x


class _Class:
    def __init__(self, w: int, members: list[int], hashes: list[np.ndarray], threshold: float):
        self.w, self.members = w, members
        self.n, self.rows = bands(least_jaccard(w, threshold))
        self.hashes = self.n * self.rows
        # Template minima by hash function, and a bitmap of their high bits.
        self.minima = np.stack([permuted(hashes[t], self.hashes).min(axis=1) for t in members], axis=1)
        self.map = np.zeros((self.hashes, 1 << 16), bool)
        self.map[np.arange(self.hashes)[:, None], self.minima >> np.uint64(48)] = True

    def candidates(self, blocks: np.ndarray) -> set[tuple[int, int]]:
        """(window, template) that share a band; ``blocks`` holds block minima by hash function."""
        mins = np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks
        near = self.map[np.arange(self.hashes)[:, None], mins >> np.uint64(48)]
        near = near.reshape(self.n, self.rows, -1).all(axis=1)
        out = set()
        for band, window in zip(*(x.tolist() for x in np.nonzero(near))):
            own = slice(band * self.rows, (band + 1) * self.rows)
            same = (self.minima[own] == mins[own, window][:, None]).all(axis=0)
            out.update((window, self.members[i]) for i in np.flatnonzero(same).tolist())
        return out


class Templates:
    """One block of templates, indexed on first use in a task."""

    def __init__(self, rows: list[tuple[str, str]], threshold: float = THRESHOLD):
        named = [(name, shingle_set(folded_words(text))) for name, text in rows]
        self.named = [(name, s) for name, s in named if s]
        self.threshold = threshold
        self._classes: list[_Class] | None = None

    def _index(self) -> list[_Class]:
        if self._classes is None:
            hashes = [
                np.concatenate([gram_hashes(WORD_HASHES.of(s.split(b" ")), SHINGLE) for s in x])
                for _, x in self.named
            ]
            by: dict[int, list[int]] = {}
            for i, (_, s) in enumerate(self.named):
                by.setdefault(window_class(len(s)), []).append(i)
            self._classes = [_Class(w, m, hashes, self.threshold) for w, m in sorted(by.items())]
        return self._classes

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, int]]:
        """(template, first word, last word, shared shingles, its shingles) of a text."""
        words = folded_words(text)
        n = len(words) - SHINGLE + 1
        if n < 1 or not self.named:
            return []
        classes = self._index()
        h = gram_hashes(WORD_HASHES.of(words), SHINGLE)
        # In chunks that are whole numbers of blocks of every class, so memory has a bound.
        chunk = max(CHUNK, classes[-1].w)
        most = max(c.hashes for c in classes)
        minima: dict[int, list[np.ndarray]] = {c.w: [] for c in classes}
        for at in range(0, n, chunk):
            x = permuted(h[at : at + chunk], most)
            for c in classes:
                own = x[: c.hashes]
                if c.w > 1:
                    own = np.minimum.reduceat(own, np.arange(0, x.shape[1], c.w), axis=1)
                minima[c.w].append(own)
        found: dict[int, list[tuple[int, int, int]]] = {}
        for c in classes:
            for window, t in c.candidates(np.concatenate(minima[c.w], axis=1)):
                _, shingles = self.named[t]
                start = window * c.w
                places = {}
                for i in range(start, min(start + 2 * c.w, n)):
                    s = b" ".join(words[i : i + SHINGLE])
                    if s in shingles:
                        places.setdefault(s, []).append(i)
                if len(places) >= least_shared(len(shingles), self.threshold):
                    at = [i for p in places.values() for i in p]
                    found.setdefault(t, []).append((min(at), max(at) + SHINGLE - 1, len(places)))
        out = []
        for t, spans in found.items():
            name, shingles = self.named[t]
            last = -1
            # Overlapping windows see one passage: spans that overlap are one match, the fullest.
            for first, end, shared in sorted(spans, key=lambda s: (s[0], -s[2], s[1])):
                if first > last:
                    out.append((name, first, end, shared, len(shingles)))
                elif shared > out[-1][3]:
                    out[-1] = (name, first, end, shared, len(shingles))
                last = max(last, end)
        return sorted(out)


_NAMES = ("license", "first_word", "last_word", "shared", "shingles")
MATCHES = ArrayType(
    StructType([StructField(n, StringType() if n == "license" else IntegerType()) for n in _NAMES])
)
_ARROW = pa.list_(pa.struct([(n, pa.string() if n == "license" else pa.int32()) for n in _NAMES]))


def _scanner(templates: Templates):
    @F.arrow_udf(MATCHES)
    def scan(texts: pa.Array) -> pa.Array:
        rows = [[dict(zip(_NAMES, m)) for m in templates.scan(t.as_py())] for t in texts]
        return pa.array(rows, _ARROW)

    return scan


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(NOTICES.items()), "name string, template string")


def license_scan(
    docs: DataFrame,
    templates: DataFrame,
    column: str = "licenses",
    text: str = "text",
    name: str = "name",
    template: str = "template",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """``docs`` with ``column``: an array of the templates each text holds, with spans in words.

    Null, empty and short texts hold none; templates of fewer than five words or without a name are
    left out; repeated rows are rows of their own. A column of that name is replaced. Templates are
    read to the driver in blocks of about ``BLOCK_WORDS`` words, all used in one pass.
    """
    given = templates.select(F.col(name).alias("n"), F.col(template).alias("t")).where(
        "n IS NOT NULL AND t IS NOT NULL"
    )
    words = given.agg(F.sum(F.size(F.split("t", "[\\s\\p{Punct}]+")))).first()[0] or 0
    blocks = -(-words // BLOCK_WORDS)
    parts, out = [], docs
    for b in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("n"), F.lit(blocks)) == b).orderBy("n", "t").collect()
        parts.append(f"_block_{uuid.uuid4().hex}")
        block = Templates([tuple(r) for r in rows], threshold)
        out = out.withColumn(parts[-1], _scanner(block)(F.col(text)))
    others = [f"`{c}`" for c in docs.columns if c != column]
    both = F.array_sort(F.concat(*parts)) if parts else F.array().cast(MATCHES)
    return out.select(*others, both.alias(column))

"""Token ids in seekable Zstandard files, so that readers decompress only what they ask for.

Layout of a file, in the public seekable format of Zstandard:

* data frames, each an independent Zstandard frame of ``FRAME_IDS`` token ids (the last has
  fewer), unsigned little-endian, two bytes an id if the vocabulary allows it and else four;
* one skippable frame (``INDEX_MAGIC``) with the document index: a compressed Arrow table of
  ``doc_id`` and ``n_tokens`` in file order, followed by its own XXH64;
* the seek table in a skippable frame (``SEEK_MAGIC``): compressed size, decompressed size and the
  low half of the content's XXH64 for each data frame, and the footer.

A plain Zstandard reader sees the ids and nothing else. The frames of a document follow from its
place in the id stream and the sizes in the seek table.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covertile.plans.workspace import Workspace

# Fixed values of the seekable format and of skippable frames.
SEEK_MAGIC = 0x184D2A5E
SEEK_FOOTER = 0x8F92EAB1
INDEX_MAGIC = 0x184D2A50
HAS_CHECKSUMS = 0x80

FRAME_IDS = 1 << 16
LEVEL = 3
KEPT_RUNS = 600_000
SLICE = 500
LETTER_THEN_MARK = re.compile(rb"(?<=[A-Za-z])[!-&(-/:-@\[-`{-~]")
END_ID = 1
LETTERS = 0x250
#: The characters that stand for single bytes in byte-level vocabularies: printable ones for themselves.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Kept(dict):
    """A bounded dictionary in two generations that makes what it lacks: a full one becomes the old one."""

    def __init__(self, size: int, made: Callable[[bytes], bytes]):
        self.size, self.made, self.old = size, made, {}

    def __missing__(self, key: bytes) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.made(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Whole texts to the bytes of their ids, exactly as the tokenizer gives them.

    The tokenizer drops white space and never joins text across it, so a text is encoded run by
    run between ASCII white space, and runs met before come from a bounded dictionary. A new run is
    made of shorter ones if it can be cut, and a run of small letters goes to the model of the
    tokenizer directly (see :meth:`made`).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        self.end = np.array([END_ID], self.dtype).tobytes()
        self.known = Kept(KEPT_RUNS, self.made)
        # Small letters that neither compose nor change, and that the tokenizer hands to its model as they are.
        small = [c for c in map(chr, range(LETTERS)) if c.isalpha() and c == c.lower()]
        self.letters = frozenset(c for c in small if all(self._plain(x) == self._modelled(x) for x in (c, f"a{c}a")))

    def _packed(self, ids: Iterable[int]) -> bytes:
        return b"".join([i.to_bytes(self.width, "little") for i in ids])

    def _plain(self, text: str) -> bytes:
        return self._packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _modelled(self, word: str) -> bytes:
        mapped = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(BYTE_CHARS)
        return self._packed([t.id for t in self.tokenizer.model.tokenize(mapped)])

    def made(self, run: bytes) -> bytes:
        """The ids of a run not met before.

        Punctuation after a letter starts a piece of its own (an apostrophe may not), so a run may be
        cut there, unless it may hold a special token.
        """
        if b"<|" not in run:
            parts = LETTER_THEN_MARK.sub(rb" \g<0>", run).split()
            if len(parts) > 1:
                return b"".join([self.known[p] for p in parts])
        text = run.decode("utf-8")
        return self._modelled(text) if self.letters.issuperset(text) else self._plain(text)

    @staticmethod
    def runs_of(text: str | None) -> list[bytes]:
        """Runs whose ids, one after the other, are those of the text.

        The tokenizer composes (NFC) and lower-cases, so A-Z may be lower-cased first, if there is
        nothing to compose before and after. Texts that hold special tokens are left alone.
        """
        if not text:
            return []
        raw = text.encode("utf-8")
        if b"<|" in raw:
            return raw.split()
        low = raw.lower()
        if text.isascii() or (is_normalized("NFC", text) and is_normalized("NFC", low.decode("utf-8"))):
            raw = low
        return raw.split()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        get = self.known.__getitem__
        return [b"".join(map(get, self.runs_of(t))) + self.end for t in texts]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Writer:
    """Writes one file; memory holds a frame and the document index."""

    def __init__(self, sink, dtype: str):
        self.sink, self.frame_bytes = sink, FRAME_IDS * np.dtype(dtype).itemsize
        self.dtype = dtype
        self.buffer = bytearray()
        self.entries: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)

    def _flush(self, content: bytes) -> None:
        packed = self.zstd.compress(content)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        self.sink.write(packed)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // np.dtype(self.dtype).itemsize)
        self.buffer += ids
        at = 0
        while len(self.buffer) - at >= self.frame_bytes:
            self._flush(bytes(self.buffer[at : at + self.frame_bytes]))
            at += self.frame_bytes
        if at:
            del self.buffer[:at]

    def close(self) -> None:
        if self.buffer:
            self._flush(bytes(self.buffer))
        table = pa.table(
            {"doc_id": pa.array(self.doc_ids, pa.int64()), "n_tokens": pa.array(self.sizes, pa.int64())},
        ).replace_schema_metadata({"dtype": self.dtype})
        raw = io.BytesIO()
        with pa.ipc.new_stream(raw, table.schema) as out:
            out.write_table(table)
        packed = self.zstd.compress(raw.getvalue())
        self.sink.write(struct.pack("<IIQ", INDEX_MAGIC, len(packed) + 8, xxhash.xxh64_intdigest(packed)))
        self.sink.write(packed)
        body = b"".join(struct.pack("<III", *e) for e in self.entries)
        footer = struct.pack("<IBI", len(self.entries), HAS_CHECKSUMS, SEEK_FOOTER)
        self.sink.write(struct.pack("<II", SEEK_MAGIC, len(body) + len(footer)) + body + footer)


class Reader:
    """Random access to one file: reads its tables once, then only the frames asked for."""

    def __init__(self, source):
        self.source, end = source, source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_FOOTER or not flags & HAS_CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        raw = self._at(end - 9 - 12 * n, 12 * n)
        self.entries = [struct.unpack_from("<III", raw, 12 * i) for i in range(n)]
        self.offsets = [0, *accumulate(e[0] for e in self.entries)]
        self.places = [0, *accumulate(e[1] for e in self.entries)]
        magic, size, digest = struct.unpack("<IIQ", self._at(self.offsets[-1], 16))
        packed = self._at(self.offsets[-1] + 16, size - 8)
        if magic != INDEX_MAGIC or xxhash.xxh64_intdigest(packed) != digest:
            raise ValueError("the document index is damaged")
        # The frame names its size, but a stream reader has no limit on it.
        raw = zstandard.ZstdDecompressor().stream_reader(packed).readall()
        table = pa.ipc.open_stream(raw).read_all()
        self.dtype = table.schema.metadata[b"dtype"].decode()
        self.doc_ids = table.column("doc_id").to_pylist()
        self.sizes = table.column("n_tokens").to_pylist()
        self.starts = [0, *accumulate(self.sizes)]
        self.frames_read = 0
        self._kept: tuple[int, bytes] = (-1, b"")
        self._zstd = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> bytes:
        if self._kept[0] != k:
            packed_size, size, check = self.entries[k]
            content = self._zstd.decompress(self._at(self.offsets[k], packed_size), max_output_size=size)
            if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.frames_read += 1
            self._kept = (k, content)
        return self._kept[1]

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document of the file."""
        width = np.dtype(self.dtype).itemsize
        start, stop = self.starts[k] * width, self.starts[k + 1] * width
        out, f = [], bisect_right(self.places, start) - 1
        while start < stop:
            end = min(stop, self.places[f + 1])
            out.append(self.frame(f)[start - self.places[f] : end - self.places[f]])
            start, f = end, f + 1
        return np.frombuffer(b"".join(out), self.dtype)


def open_file(uri: str) -> Reader:
    store, path = fs.FileSystem.from_uri(uri)
    return Reader(store.open_input_file(path))


def _write_part(root: str, tokenizer: str):
    """For mapInArrow over (doc_id, text) in order: one file and its manifest row for a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        # Attempts write apart; only files of attempts whose manifest row Spark commits count.
        uri = f"{root}/{part:06d}-{uuid.uuid4().hex}.zst"
        writer = sink = None
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, SLICE):
                if writer is None:
                    store, path = fs.FileSystem.from_uri(uri)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    sink = store.open_output_stream(path, compression=None)
                    writer = Writer(sink, encoder.dtype)
                encoded = encoder.encode(texts.slice(at, SLICE).to_pylist())
                for doc_id, x in zip(ids.slice(at, SLICE).to_pylist(), encoded):
                    writer.add(doc_id, x)
        if writer:
            writer.close()
            sink.close()
            row = {"part": [part], "path": [uri], "n_docs": [len(writer.sizes)], "n_tokens": [sum(writer.sizes)]}
            yield pa.RecordBatch.from_pydict(row, pa.schema(MANIFEST))

    return run


MANIFEST = [("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    root: str | None = None,
) -> DataFrame:
    """Encode ``docs`` in ascending id order; returns the manifest, one row per file.

    ``part, path, n_docs, n_tokens``: files by ``part`` hold consecutive ranges of ids. A null
    text is empty (the end id alone), a null id comes first, rows that repeat an id follow each
    other by text, other columns are ignored. ``tokenizer`` is the path of its file on every
    executor; ``root`` a folder all executors reach, by default one below spark.checkpoint.dir.
    Range partitions by id are a shuffle whose pieces Spark sizes; no task holds more than a
    frame of ids. An empty table gives an empty manifest.
    """
    ws = Workspace(docs.sparkSession, "tokens")
    spread = (
        docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    made = spread.mapInArrow(
        _write_part(root or ws.path("files"), tokenizer),
        "part int, path string, n_docs bigint, n_tokens bigint",
    )
    return ws.write(made, "manifest")


def read_token_files(
    spark: SparkSession, manifest: DataFrame, doc_ids: list[int] | None = None, ids: bool = True
) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and with ``ids`` the ids of each document, from files.

    ``doc_ids`` asks for some documents: only their frames are decompressed. ``start`` counts the
    ids of all documents before. The driver sees the manifest only, a row for each file.
    """
    files = [r.asDict() for r in manifest.orderBy("part").collect()]
    bases = accumulate((f["n_tokens"] for f in files), initial=0)
    rows = [(f["path"], base) for f, base in zip(files, bases)]
    wanted = None if doc_ids is None else frozenset(doc_ids)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(c.to_pylist() for c in batch.columns)):
                out: list[tuple] = []
                held, reader = 0, open_file(path)
                for k, doc_id in enumerate(reader.doc_ids):
                    if wanted is not None and doc_id not in wanted:
                        continue
                    x = reader.ids(k).astype("<u4")
                    row = (doc_id, base + reader.starts[k], len(x), zlib.crc32(x))
                    out.append((*row, x) if ids else row)
                    held += len(x)
                    if held > 1 << 20:
                        yield _batch(out, ids)
                        out, held = [], 0
                if out:
                    yield _batch(out, ids)

    def _batch(out: list[tuple], ids: bool) -> pa.RecordBatch:
        columns = [pa.array(c, pa.int64()) for c in list(zip(*out))[:4]]
        if ids:
            columns.append(pa.array([r[4].astype(np.int64) for r in out], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    listed = spark.createDataFrame(rows, "path string, base bigint")
    # A task for each file: the rows of the list are few and small, their files are not.
    return listed.repartition(max(1, len(rows))).mapInArrow(
        run, schema + (", ids array<bigint>" if ids else "")
    )

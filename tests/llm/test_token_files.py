"""Token files: exact round trip, checksums, and frames read for single documents."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from covertile.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    odd = ["<|endoftext|>", "a<|endoftext|>b", "it's", "ÉTÉ", "éa", "́x", "ΣΑΣ", "x\x1cy", "a b",
           "　", "日本語", "١٢٣", "i̇", "…", "'S", "don't!!", "\x85", "A​B", "ſ", "🙂🙂", "word.", "Word!!", "it's.", "IT'S,", "x'", "x'.", "a1.", "été.", "H̱.", "H\u0331a", "A\u030a", "É.b.", "e.g.x", "a`b", "a_b", "a~", "a\u0301.", "<|startoftext|>", "<|END|>.",
           "a<|", "-|", "'re", "we're!", "\x1c.", "a\x7f."]
    seps = [" ", "  ", "\n", "\t", "\x0b", "\r\n"]
    out = [(None, "null id"), (5, None), (6, ""), (7, " \n"), (7, "again"), (7, "again"), (2, "x" * 5000)]
    for i in range(300):
        n = rng.choice([1, 5, 60])
        out.append((100 + i * 3, "".join(rng.choice(odd) + rng.choice(seps) for _ in range(n))))
    out.append((50, " ".join(f"w{rng.randrange(10**6)}" for _ in range(60_000))))
    return out


def test_encoder_equals_tokenizer_when_its_dictionaries_are_small(rows):
    plain, encoder = Tokenizer.from_file(PATH), tf.Encoder(PATH)
    encoder.known.size = 7
    for _, text in rows * 2:
        want = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == want


def test_round_trip(spark, rows):
    plain = Tokenizer.from_file(PATH)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumnRenamed("x", "ids")
    docs = docs.selectExpr("*", "'a' AS start", "1 AS n_tokens").repartition(5)
    manifest = tf.write_token_files(docs, PATH)
    got = tf.read_token_files(spark, manifest).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, want = 0, []
    for doc_id, text in order:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want
    # Some documents only
    some = tf.read_token_files(spark, manifest, [50, 6, 12345], ids=False).collect()
    assert sorted(tuple(r) for r in some) == sorted(w[:4] for w in want if w[0] in (50, 6))


def test_reader_takes_only_the_frames_it_needs(tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "FRAME_IDS", 100)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 60000, n).astype("<u2") for n in (1, 250, 99, 1, 100, 7, 640)]
    path = tmp_path / "x.zst"
    with path.open("wb") as sink:
        writer = tf.Writer(sink, "<u2")
        for i, d in enumerate(docs):
            writer.add(i, d.tobytes())
        writer.close()
    reader = tf.open_file(str(path))
    assert reader.ids(5).tolist() == docs[5].tolist() and reader.frames_read == 1
    assert all(reader.ids(k).tolist() == d.tolist() for k, d in enumerate(docs))
    # Any Zstandard reader gets the ids and nothing else.
    whole = zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True).readall()
    assert whole == b"".join(d.tobytes() for d in docs)
    # A flipped bit is found.
    raw = bytearray(path.read_bytes())
    raw[reader.offsets[3] + 20] ^= 1
    path.write_bytes(raw)
    with pytest.raises(Exception):
        tf.open_file(str(path)).ids(6)
        [tf.open_file(str(path)).ids(k) for k in range(7)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    manifest = tf.write_token_files(docs, PATH)
    assert manifest.count() == 0 and tf.read_token_files(spark, manifest).collect() == []


def test_runs_of_small_letters_go_to_the_model_and_repeats_to_no_tokenizer(rows):
    """A call of the tokenizer costs several times its model, so only other runs take one."""
    plain, encoder = Tokenizer.from_file(PATH), tf.Encoder(PATH)
    asked = []
    whole = encoder._plain
    encoder._plain = lambda text: (asked.append(text), whole(text))[1]
    words = ["été", "naïve", "straße", "œuvre", "ıslak", "word", "Word,", "e.g.", "łódź"]
    text = " ".join(words * 20)
    want = [*plain.encode(text, add_special_tokens=False).ids, 1]
    assert np.frombuffer(encoder.encode([text])[0], encoder.dtype).tolist() == want
    assert sorted(asked) == [",", ".", ".g"]
    encoder.encode([t for _, t in rows])
    met = len(asked)
    encoder.encode([t for _, t in rows])
    assert len(asked) == met

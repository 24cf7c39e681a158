import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import common, packing, tokens
from siltstone.llm.tokens import Encoder, Sparing
from tests.llm.helpers import documents, texts

FILE = public_tokenizers.path("byte_bpe_50k.json")


PLAIN = Tokenizer.from_file(FILE)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_the_library():
    encode = Encoder(FILE)
    rng = random.Random(1)
    pieces = ["a", "Word", " ", "  ", "\n", "\t", "1", "'s", "é", "　", "\x1f", "!!", "日本", "\x00", "don't", "word...", "'s", "_", "naïve", "!?", "<|endoftext|>", "<|", "|>"]
    for text in [*texts(), *("".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(2000))]:
        assert np.frombuffer(encode.ids(text), "<u4").tolist() == plain_ids(text), repr(text)


def test_words_that_come_once_take_no_memory():
    """A task that packs remembers the words that come again, and nothing of other operators."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=12)) for _ in range(3000)]
    common.forget()
    of_others = tokens.encoder(FILE)
    of_others.ids("words of another operator")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array([" ".join(words), "again " * 2 + "and again", " ".join(words[:20])])], names=["doc_id", "text"])
    for made in packing._pieces(FILE, 1, 2048)(iter([batch])):
        assert sum(made.column("length").to_pylist()) == sum(len(plain_ids(x)) + 1 for x in batch.column("text").to_pylist())
    assert 20 <= sum(map(len, common.memories)) < 100
    assert not of_others
    common.forget()


def test_sparing_encoder_equals_the_library(monkeypatch):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abé", k=rng.randint(1, 6))) for _ in range(300)]
    made = [" ".join(rng.choices(vocabulary, k=40)) + rng.choice("! \n") for _ in range(100)]
    for few, marks in ((400_000, 1 << 22), (20, 64), (1, 1)):
        monkeypatch.setattr(tokens, "FEW", few)
        monkeypatch.setattr(tokens, "MARKS", marks)
        encode = Sparing(FILE)
        for text in [*texts(), *made]:
            assert np.frombuffer(encode.ids(text), "<u4").tolist() == plain_ids(text), repr(text)
            assert len(encode) <= few


def test_texts_come_in_small_batches(spark, monkeypatch):
    """Spark hands documents over by bytes, not by ten thousand rows; the session's setting is as before."""
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(packing, "staged", lambda df, what, f=packing.staged: seen.append((what, int(spark.conf.get(name).rstrip("b")))) or f(df, what))
    assert packing.packed(documents(spark, [(i, "x" * 300_000) for i in range(30)]), FILE).groupBy("doc_id").count().count() == 30
    assert dict(seen)["pack-pieces"] <= 4 << 20 and spark.conf.get(name) == before


def test_best_fit_is_the_tightest():
    rng = random.Random(2)
    for window in (1, 2, 7, 64, 100):
        lengths = sorted((rng.randint(1, window) for _ in range(300)), reverse=True)
        left, want = [], []
        for n in lengths:
            fits = [(c, i) for i, c in enumerate(left) if c >= n]
            if fits:
                want.append(min(fits)[0])
                i = min(fits)[1]
            else:
                want.append(window)
                i = len(left)
                left.append(window)
            left[i] -= n
        got = packing.best_fit(lengths, window)
        assert [window - o for _, o in got] == want
        assert max(n for n, _ in got) + 1 == len(left)


def check(spark, rows, window, **more):
    ids = defaultdict(list)
    for d, t in rows:
        ids[d].append(np.array([*plain_ids(t), 1], "<u4"))
    out = packing.packed(documents(spark, rows), FILE, window=window, **more).collect()
    assert sum(r.length for r in out) == sum(len(x) for v in ids.values() for x in v)
    for r in out:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return out, sequences


def test_packs_every_id_once(spark):
    rows = [*enumerate(texts()), (None, "null id"), (None, None), (3, "a"), (3, "a")]
    check(spark, rows, 64)
    check(spark, rows, 64, group_pieces=3)
    out, sequences = check(spark, [(i, "w" * (i % 50)) for i in range(300)], 32)
    assert sum(r.length for r in out) > 0.98 * 32 * (len(sequences) - 1)


def test_many_equal_pieces_are_dealt_to_several_groups(spark):
    out, _ = check(spark, [*((None, "same") for _ in range(400)), *((i, f"text {i}") for i in range(100))], 16, group_pieces=50)
    sizes = defaultdict(int)
    for r in out:
        sizes[r.sequence_id >> packing.GROUP_BITS] += 1
    assert len(sizes) > 5 and max(sizes.values()) < 150
    docs = documents(spark, [(1, "a b"), (2, None)]).withColumns({c: F.lit("clash") for c in ("start", "length", "pack_group", "row_no", "shares", "ids_crc32")})
    assert packing.packed(docs, FILE).count() == 2


def test_empty(spark):
    assert packing.packed(documents(spark, []), FILE).count() == 0

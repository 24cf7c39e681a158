import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import token_files, tokens, wavelet
from siltstone.llm.common import shared_path
from tests.llm.helpers import documents, texts

FILE = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(FILE)


def test_wavelet_round_trip_and_lookups(monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK", 16)
    rng = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (1000, 2), (1500, 300), (700, 70_000), (5, 1)):
        ids = rng.integers(0, top, n).astype("<u4")
        cut = [n // 3, n - n // 3]
        w = wavelet.Wavelet(wavelet.write(ids, [7, None], cut))
        assert w.ids().tolist() == ids.tolist()
        assert w.documents()[0] == [7, None] and w.documents()[1].tolist() == cut
        for i in range(0, n, 37):
            assert w.access(i) == ids[i]
        for token in [*np.unique(ids)[:20].tolist(), top + 1]:
            places = np.flatnonzero(ids == token)
            assert w.count(token) == len(places)
            assert w.count(token, n // 4, n // 2) == ((places >= n // 4) & (places < n // 2)).sum()
            for k in range(0, len(places), 5):
                assert w.find(token, k) == places[k]
            with pytest.raises(IndexError):
                w.find(token, len(places))


def test_wavelet_parts(monkeypatch):
    """Ids dealt part by part, the last one short: the same file, and the same ids read."""
    ids = np.random.default_rng(6).integers(0, 50_000, 1003).astype("<u4")
    whole = wavelet.write(ids, [1], [1003])
    for part in (1, 64, 1003):
        monkeypatch.setattr(wavelet, "PART", part)
        assert wavelet.write(ids, [1], [1003]) == whole
        assert wavelet.Wavelet(whole).ids().tolist() == ids.tolist()


def test_texts_together(monkeypatch):
    """Each text's ids are the tokenizer's, and a cut is looked up once for all texts that are cut together."""
    seen = []

    class Counting(tokens.Encoder):
        def __getitem__(self, cut):
            seen.append(cut)
            return super().__getitem__(cut)

    plain = ["one two two\ntwo one", "two", "Ünï two\n日本語 two"] * 50
    made = list(Counting(FILE).ids_of_all(plain))
    assert [np.frombuffer(x, "<u4").tolist() for x in made] == [PLAIN.encode(t, add_special_tokens=False).ids for t in plain]
    assert len(seen) < 20 and seen.count(" two") == 1
    hard = [*texts(), "a\nb", "a \nb", " a", "a\n", "x's y'll 12 345, <|endoftext|> z", "\x00", "tab\tin", *plain]
    want = [PLAIN.encode(t or "", add_special_tokens=False).ids for t in hard]
    for most in (1, 30, 4000, 1 << 22):
        monkeypatch.setattr(tokens, "TOGETHER", most)
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(FILE).ids_of_all(hard)] == want
    assert list(tokens.Encoder(FILE).ids_of_all([])) == []


def test_files_hold_every_id(spark):
    rows = [*((i * 3 % 11, t) for i, t in enumerate(texts())), (None, "null id"), (5, "twice"), (5, "twice"), (2**40, "far")]
    folder = shared_path(spark, "token-files")
    docs = documents(spark, rows).withColumns({c: F.lit("clash") for c in ("file", "part", "start", "base", "n_tokens")})
    files = token_files.write_token_files(docs, folder, FILE, shard_ids=500, range_bytes=2000)
    assert files.count() > 3
    out = token_files.read_token_files(spark, folder, files).orderBy("start").collect()
    ids = [r.doc_id for r in out]
    assert ids == sorted((d for d, _ in rows if d is not None)) + [None]
    want = {}
    for d, t in rows:
        x = np.array([*PLAIN.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.setdefault(d, set()).add((len(x), zlib.crc32(x.tobytes())))
    at = 0
    for r in out:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens


def test_empty(spark):
    folder = shared_path(spark, "token-files")
    files = token_files.write_token_files(documents(spark, []), folder, FILE)
    assert token_files.read_token_files(spark, folder, files).count() == 0

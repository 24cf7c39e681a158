"""Token ids of whole texts by the tokenizers library, with a bounded memory of words.

A byte-level BPE of the usual split pattern never merges across a single space or line feed
that stands between two other non-blank characters: the space opens the next piece and the line
feed is a piece of its own. A text without blanks side by side can thus be cut there, and equal
cuts get equal ids, so each worker encodes a frequent word once. Many such texts are cut together, as bytes, and each
distinct cut of theirs is looked up once. Any other text is cut only at
single spaces between two non-blanks, by a pattern. The strings of special tokens are found as the library finds them:
they have neither blanks nor letters alone, so no cut divides one and each goes to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from siltstone.llm.common import forget, memories

#: Most words that one worker remembers, and the longest of them in characters.
MEMORY, LONGEST = 1_200_000, 48
#: Most words that a sparing encoder remembers, and marks that it has for those met once.
FEW, MARKS = 400_000, 1 << 22
#: Bytes of texts that are cut together.
TOGETHER = 4 << 20

_CUT = re.compile(r"(?<=\S)(?= \S)")
#: A cut that is one piece, of Latin letters, or two, with marks behind them.
_WORD = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-/:-@\[-`{-~]+)?")


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if printable, else from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


_SIGNS = _byte_signs()
_SPACE = chr(_SIGNS[32])


def _plain(text: str) -> bool:
    """No blanks side by side or at an end, and none but spaces and line feeds."""
    flat = text.replace("\n", " ")
    return flat.isprintable() and "  " not in flat and flat[0] != " " and flat[-1] != " "


class Encoder(dict):
    """A mapping of text cuts to their ids as unsigned 32-bit integers of a little-endian machine."""

    def __init__(self, tokenizer_file: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model

    def __missing__(self, cut: str) -> bytes:
        word = _WORD.fullmatch(cut)
        if word and word[2]:
            ids = self[word[1]] + self[word[2]]
        elif word:  # one piece: the library's merges alone
            signs = cut.replace(" ", _SPACE) if cut.isascii() else cut.encode().decode("latin-1").translate(_SIGNS)
            ids = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
        else:
            ids = array("I", self.tokenizer.encode(cut, add_special_tokens=False).ids).tobytes()
        if len(cut) <= LONGEST:
            self._remember(cut, ids)
        return ids

    def _remember(self, cut: str, ids: bytes) -> None:
        if len(self) >= MEMORY:
            self.clear()
        self[cut] = ids

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text; null counts as empty."""
        if not text:
            return b""
        if _plain(text):
            cuts = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")
        else:
            cuts = _CUT.split(text)
        return b"".join(map(self.__getitem__, cuts))

    def ids_of_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order; holds TOGETHER bytes and the longest text."""
        held: list[str | None] = []
        size = 0
        for text in texts:
            held.append(text)
            size += len((text or "").encode())
            if size >= TOGETHER:
                yield from self._ids_together(held)
                held, size = [], 0
        yield from self._ids_together(held)

    def _ids_together(self, texts: list[str | None]) -> list[bytes]:
        together = [i for i, text in enumerate(texts) if text and len(text) < TOGETHER and _plain(text)]
        out = [b""] * len(texts)
        for i in {*range(len(texts))}.difference(together):
            out[i] = self.ids(texts[i])
        if not together:
            return out
        parts = [texts[i].encode() for i in together]
        raw, ends = np.frombuffer(b"".join(parts), "u1"), np.cumsum([len(x) for x in parts])
        # a cut begins with a text, at a blank and behind a line feed
        begins, feeds = np.ones(len(raw) + 1, bool), raw == ord("\n")
        begins[1:-1] = (feeds | (raw == ord(" ")))[1:] | feeds[:-1]
        begins[ends] = True
        offsets = np.flatnonzero(begins).astype(np.int32)
        cuts = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw)).dictionary_encode()
        known, which = list(map(self.__getitem__, cuts.dictionary.to_numpy(zero_copy_only=False))), cuts.indices.to_numpy()
        sizes, table = np.fromiter(map(len, known), np.int64, len(known)) // 4, np.frombuffer(b"".join(known), "<u4")
        n = sizes[which]
        upto = np.cumsum(n)
        at = np.repeat((np.cumsum(sizes) - sizes)[which] - (upto - n), n)
        at += np.arange(len(at))
        ids = table.take(at)
        stops = upto[np.searchsorted(offsets, ends) - 1].tolist()
        for i, a, b in zip(together, [0, *stops], stops):
            out[i] = ids[a:b].tobytes()
        return out


class Sparing(Encoder):
    """An encoder that remembers a word when it comes a second time: words that come once, most of a large vocabulary, take no memory.

    A word that shares its mark with another may be remembered at once; the ids are the same either way.
    """

    def __init__(self, tokenizer_file: str) -> None:
        super().__init__(tokenizer_file)
        self.met, self.marked = bytearray(MARKS), 0

    def clear(self) -> None:
        super().clear()
        self.met, self.marked = bytearray(MARKS), 0

    def _remember(self, cut: str, ids: bytes) -> None:
        mark = hash(cut) % MARKS
        if self.met[mark]:
            if len(self) >= FEW:
                super().clear()
            self[cut] = ids
            return
        if self.marked >= MARKS // 2:
            self.met, self.marked = bytearray(MARKS), 0
        self.met[mark] = 1
        self.marked += 1


_encoders: dict[tuple[str, type[Encoder]], Encoder] = {}


def encoder(tokenizer_file: str, kind: type[Encoder] = Encoder) -> Encoder:
    """One encoder of a kind for each file and worker process; the worker forgets what other operators remember."""
    key = tokenizer_file, kind
    if key not in _encoders:
        _encoders[key] = kind(tokenizer_file)
        memories.append(_encoders[key])
    forget(_encoders[key])
    return _encoders[key]

"""The block codec: a new content as copies of aligned old blocks and literals.

The scan takes, from left to right, the first place in the new content whose 4096 bytes
equal an aligned old block (of equal blocks the last one), and goes on behind it. Places are
found by comparing eight bytes at a window's start and end in bulk; only those left are compared whole.
"""

from __future__ import annotations

import struct

import numpy as np

from siltstone import schema as S


def _candidates(blocks: np.ndarray, new: bytes) -> np.ndarray:
    """Places in new whose first and last eight bytes occur as those of blocks."""
    n = len(new) - S.BLOCK + 1
    if n <= 0 or not len(blocks):
        return np.empty(0, np.int64)
    eights = np.lib.stride_tricks.as_strided(np.frombuffer(new, "u1"), (len(new) - 7, 8), (1, 1))
    words = np.ascontiguousarray(eights).view("<u8").ravel()
    heads = np.ascontiguousarray(blocks[:, :8]).view("<u8").ravel()
    tails = np.ascontiguousarray(blocks[:, -8:]).view("<u8").ravel()
    at = np.flatnonzero(np.isin(words[:n], heads))
    return at[np.isin(words[at + S.BLOCK - 8], tails)]


def instructions(old: bytes, new: bytes) -> list[tuple[int, int, int, bytes]]:
    """(kind, offset, size, literal) that make new from old."""
    count = len(old) // S.BLOCK
    place = {old[i * S.BLOCK : (i + 1) * S.BLOCK]: i * S.BLOCK for i in range(count)}
    blocks = np.frombuffer(old, "u1", count * S.BLOCK).reshape(count, S.BLOCK)
    out: list[tuple[int, int, int, bytes]] = []
    done = 0

    def literal(end: int) -> None:
        out.extend((S.LITERAL, 0, len(part), part) for part in (new[i : min(end, i + S.MOST_LITERAL)] for i in range(done, end, S.MOST_LITERAL)))

    for at in _candidates(blocks, new).tolist():
        if at >= done and (offset := place.get(new[at : at + S.BLOCK])) is not None:
            literal(at)
            out.append((S.COPY, offset, S.BLOCK, b""))
            done = at + S.BLOCK
    literal(len(new))
    return out


def encode(old: bytes, new: bytes) -> bytes:
    """The instructions in their binary format."""
    made = instructions(old, new)
    parts = [struct.pack(S.DELTA_HEADER, S.DELTA_MAGIC, len(made), len(old))]
    for kind, offset, size, literal in made:
        parts += struct.pack(S.INSTRUCTION, kind, offset, size), literal
    return b"".join(parts)


def decode(delta: bytes) -> tuple[int, list[tuple[int, int, int, bytes]]]:
    """(old size, instructions); any kind but a copy is a literal, and bytes after the last are ignored."""
    if len(delta) < S.DELTA_HEADER_BYTES:
        raise ValueError("a delta is shorter than its header")
    magic, count, old_size = struct.unpack_from(S.DELTA_HEADER, delta)
    if magic != S.DELTA_MAGIC:
        raise ValueError("not a delta")
    out, at = [], S.DELTA_HEADER_BYTES
    for _ in range(count):
        if at + S.INSTRUCTION_BYTES > len(delta):
            raise ValueError("a delta ends within an instruction")
        kind, offset, size = struct.unpack_from(S.INSTRUCTION, delta, at)
        at += S.INSTRUCTION_BYTES
        literal = b""
        if kind != S.COPY:
            if at + size > len(delta):
                raise ValueError("a delta ends within a literal")
            literal = delta[at : at + size]
            at += size
        out.append((kind, offset, size, literal))
    return old_size, out


def apply(delta: bytes, old: bytes) -> bytes:
    """The new content; an old content that is longer than the delta says is cut."""
    size, made = decode(delta)
    if len(old) < size:
        raise ValueError("the old content is shorter than the delta says")
    parts = []
    for kind, offset, length, literal in made:
        if kind == S.COPY and offset + length > size:
            raise ValueError("a copy reaches beyond the old content")
        parts.append(old[offset : offset + length] if kind == S.COPY else literal)
    return b"".join(parts)

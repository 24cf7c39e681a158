import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone import schema as S
from siltstone.functions import blocks

RNG = random.Random(1)
A, B, C = (RNG.randbytes(S.BLOCK) for _ in range(3))


def brief(old, new):
    return [f"C({o})" if k == S.COPY else f"L({n})" for k, o, n, _ in blocks.instructions(old, new)]


@pytest.mark.parametrize(
    ("old", "new", "want", "size"),
    [
        (b"", b"", [], 16),
        (A, b"", [], 16),
        (b"", b"x", ["L(1)"], 30),
        (A[:4095], A[:4095], ["L(4095)"], 4124),
        (A, A, ["C(0)"], 29),
        (A + b"x", A + b"x", ["C(0)", "L(1)"], 43),
        (A + B, A + B, ["C(0)", "C(4096)"], 42),
        (A + B, B + A, ["C(4096)", "C(0)"], 42),
        (A + B + A, A, ["C(8192)"], 29),
        (A + B + C, b"x" + A + B + C, ["L(1)", "C(0)", "C(4096)", "C(8192)"], 69),
        (A + B + C, (A + B + C)[1:], ["L(4095)", "C(4096)", "C(8192)"], 4150),
        (b"", bytes(65535), ["L(65535)"], 65564),
        (b"", bytes(65536), ["L(65535)", "L(1)"], 65578),
    ],
)
def test_expected_instructions(old, new, want, size):
    assert brief(old, new) == want
    assert len(blocks.encode(old, new)) == size
    assert blocks.apply(blocks.encode(old, new), old) == new


def slow(old, new):
    """The scan as it is defined, byte by byte."""
    place = {old[i : i + S.BLOCK]: i for i in range(0, len(old) - S.BLOCK + 1, S.BLOCK)}
    at, out = 0, []
    while at < len(new):
        if len(new) - at >= S.BLOCK and new[at : at + S.BLOCK] in place:
            out.append(place[new[at : at + S.BLOCK]])
            at += S.BLOCK
        else:
            at += 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([A, B, C, A[:100], bytes(S.BLOCK), b"z", bytes(10)]), max_size=6), st.lists(st.sampled_from([A, B, C, A[50:], bytes(S.BLOCK), b"y", bytes(7)]), max_size=6))
def test_round_trip_and_greedy_scan(old, new):
    old, new = b"".join(old), b"".join(new)
    assert blocks.apply(blocks.encode(old, new), old) == new
    assert [o for k, o, _, _ in blocks.instructions(old, new) if k == S.COPY] == slow(old, new)


def test_errors_and_tolerance():
    made = blocks.encode(A, A + b"tail")
    assert blocks.apply(made + b"more", A + b"longer") == A + b"tail"
    for broken, old in ((b"", A), (b"XXXX" + made[4:], A), (made[:-1], A), (made[:20], A), (made, A[:-1])):
        with pytest.raises(ValueError):
            blocks.apply(broken, old)
    beyond = bytearray(made)
    beyond[17] = 1  # a copy from offset 1 reaches beyond the old content
    with pytest.raises(ValueError):
        blocks.apply(bytes(beyond), A)

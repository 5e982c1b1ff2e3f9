"""The uniforms of numeric.hash_uniform for many trials at once, as numpy arrays inside tasks.

A stress study draws billions of digests that differ in the trial only, so md5 runs over arrays here: the
words that hold the trial are the same for every name, the others for every trial.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal
from math import sin

import numpy as np

_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_SINES = np.array([int(abs(sin(i + 1)) * 2**32) for i in range(64)], dtype=np.uint32)[:, None, None]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_PLACES = [*range(16), *[(5 * i + 1) % 16 for i in range(16)], *[(3 * i + 5) % 16 for i in range(16)], *[7 * i % 16 for i in range(16)]]
_ONE_BLOCK = 55  # bytes of a message that fill no second block
_CELLS = 1 << 14  # digests at once, so that the arrays stay in the processor's cache


def _md5_words(words: list[np.ndarray], shape: tuple[int, int]) -> list[np.ndarray]:
    """The first three words of the md5 of one-block messages, given as 16 arrays that broadcast to `shape`."""
    a, b, c, d = (np.full(shape, v, dtype=np.uint32) for v in _START)
    f = np.empty(shape, dtype=np.uint32)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        f += a
        f += words[_PLACES[i]] + _SINES[i]
        by = _TURNS[turn][i % 4]
        np.left_shift(f, by, out=a), np.right_shift(f, 32 - by, out=f)
        a |= f
        a += b
        a, b, c, d = d, a, b, c
    return [x + np.full((1, 1), v, dtype=np.uint32) for x, v in zip((a, b, c), _START)]


def _one_block(head: bytes, trials: range, tails: list[bytes]) -> np.ndarray:
    """Draws of trials that have equally many digits, for tails that leave the message in one block."""
    digits = len(str(trials[0]))
    at = len(head) + digits
    left = np.frombuffer(b"".join((head + str(t).encode()).ljust(64, b"\0") for t in trials), dtype="<u4").reshape(-1, 16)
    right = np.frombuffer(
        b"".join((bytes(at) + tail + b"\x80").ljust(56, b"\0") + (8 * (at + len(tail))).to_bytes(8, "little") for tail in tails), dtype="<u4"
    ).reshape(-1, 16)
    varies = range(len(head) // 4, (at - 1) // 4 + 1)
    words = [(left[:, j][None, :] if j in varies else left[:1, j][None, :]) | right[:, j][:, None] for j in range(16)]
    found = _md5_words(words, (len(tails), len(trials)))
    return np.stack([w.byteswap() for w in found]) / 4294967296.0


def trial_draws(head: str, names: Sequence[str], trials: range) -> np.ndarray:
    """Segments 0 to 2 of hash_uniform(hash_digest(head, trial, name)): an array (segment, name, trial)."""
    lead = f"{head}|".encode()
    tails = [f"|{name}".encode() for name in names]
    out = np.empty((3, len(tails), len(trials)))
    at = 0
    while at < len(trials):
        digits = len(str(trials[at]))
        upto = min(len(trials), at + 10**digits - trials[at])
        part = trials[at:upto]
        short = [i for i, tail in enumerate(tails) if len(lead) + digits + len(tail) <= _ONE_BLOCK]
        step = max(1, _CELLS // len(part))
        for k in range(0, len(short), step):
            own = short[k : k + step]
            out[:, own, at:upto] = _one_block(lead, part, [tails[i] for i in own])
        for i in set(range(len(tails))) - set(short):
            whole = b"".join(hashlib.md5(lead + str(t).encode() + tails[i]).digest()[:12] for t in part)
            out[:, i, at:upto] = np.frombuffer(whole, dtype=">u4").reshape(-1, 3).T / 4294967296.0
        at = upto
    return out


def whole_steps(values: np.ndarray, places: int) -> np.ndarray:
    """Non-negative doubles in steps of 10 ** -places, rounded half up in their decimal notation as Spark's round does."""
    scaled = values * 10.0**places
    steps = np.floor(scaled + 0.5).astype(np.int64)
    unsure = np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6 + 4e-16 * scaled
    for spot in zip(*np.nonzero(unsure)):
        steps[spot] = int(Decimal(repr(float(values[spot]))).scaleb(places).quantize(Decimal(1), ROUND_HALF_UP))
    return steps


def runs(*columns: Sequence) -> Iterator[tuple[int, int]]:
    """First and next-after-last place of each stretch of equal rows."""
    n, at = len(columns[0]), 0
    for i in range(1, n + 1):
        if i == n or any(c[i] != c[at] for c in columns):
            yield at, i
            at = i

"""SHA-256 over many messages at once, with the state between two blocks as plain data.

A state is an array of shape (8, lanes), a block one of shape (16, lanes); every function works
on all lanes together. Digests are rows of 32 bytes, and their hex text is exactly one block, so
the state before a child digest is all that a parent's hash knows of what stands left of it.
"""

from __future__ import annotations

import math

import numpy as np


def _primes(n: int) -> list[int]:
    found: list[int] = []
    k = 2
    while len(found) < n:
        if all(k % p for p in found):
            found.append(k)
        k += 1
    return found


def _cube_root(x: int) -> int:
    low, high = 0, 1 << (x.bit_length() // 3 + 1)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if mid ** 3 <= x else (low, mid - 1)
    return low


# the first 32 bits of the fractions of the primes' cube and square roots
_ROUNDS = [_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)]
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], dtype=np.uint32).reshape(8, 1)
_HEX = np.frombuffer(b"0123456789abcdef", dtype=np.uint8)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(state: np.ndarray, block: np.ndarray) -> np.ndarray:
    """The state after one more block; one lane of either side serves all lanes of the other."""
    w = list(block)
    a, b, c, d, e, f, g, h = state
    for t in range(64):
        at = t % 16
        if t >= 16:
            x, y = w[(t + 1) % 16], w[(t + 14) % 16]
            w[at] = (w[at] + (_turn(x, 7) ^ _turn(x, 18) ^ (x >> np.uint32(3)))
                     + w[(t + 9) % 16] + (_turn(y, 17) ^ _turn(y, 19) ^ (y >> np.uint32(10))))
        one = (h + (_turn(e, 6) ^ _turn(e, 11) ^ _turn(e, 25)) + (g ^ (e & (f ^ g)))
               + np.uint32(_ROUNDS[t]) + w[at])
        two = (_turn(a, 2) ^ _turn(a, 13) ^ _turn(a, 22)) + ((a & b) | (c & (a | b)))
        a, b, c, d, e, f, g, h = one + two, a, b, c, d + one, e, f, g
    return state + np.stack([a, b, c, d, e, f, g, h])


def start(lanes: int) -> np.ndarray:
    return np.repeat(START, lanes, axis=1)


def hex_blocks(digests: np.ndarray) -> np.ndarray:
    """Blocks of the digests' lower-case hex text."""
    text = np.empty((len(digests), 64), dtype=np.uint8)
    text[:, 0::2] = _HEX[digests >> 4]
    text[:, 1::2] = _HEX[digests & 15]
    return text.view(">u4").astype(np.uint32).T


def finish(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests of messages of ``blocks`` whole blocks (a number per lane) that led to ``state``."""
    end = np.zeros((16, len(blocks)), dtype=np.uint32)
    end[0] = 0x80000000
    bits = blocks.astype(np.uint64) * np.uint64(512)
    end[14], end[15] = bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF)
    return digest_rows(compress(state, end))


def digest_rows(state: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(state.T.astype(">u4")).view(np.uint8).reshape(-1, 32)


def state_rows(state: np.ndarray) -> np.ndarray:
    """A state as rows of 32 bytes, as it is stored."""
    return digest_rows(state)


def states_of(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(rows).view(">u4").astype(np.uint32).reshape(-1, 8).T

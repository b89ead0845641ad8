"""Fuzzy keys from the perfect binary Golay code of length 23."""

from __future__ import annotations

import functools

import numpy as np

# Length, message bits and generator polynomial of the code.
LENGTH = 23
MESSAGE_BITS = 12
GENERATOR = 0b101011100011


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of each word (23 bits, a polynomial over GF(2)) by the generator."""
    out = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, LENGTH - MESSAGE_BITS - 1, -1):
        out ^= np.where((out >> bit) & 1, GENERATOR << (bit - (LENGTH - MESSAGE_BITS)), 0)
    return out


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits of a word, and the error of each remainder.

    The code is perfect: the words of weight 0 to 3 have the 2048 remainders, each once.
    """
    low = _remainder(np.arange(1 << 12))
    high = _remainder(np.arange(1 << 11) << 12)
    bits = 1 << np.arange(LENGTH)
    pairs = (bits[:, None] | bits[None, :]).ravel()
    errors = np.unique(np.concatenate([[0], bits, pairs, (pairs[:, None] | bits[None, :]).ravel()]))
    table = np.zeros(1 << (LENGTH - MESSAGE_BITS), np.int64)
    table[_remainder(errors)] = errors
    return low, high, table


def decode(words: np.ndarray) -> np.ndarray:
    """Index (message bits) of the only codeword within three bits of each 23-bit word."""
    low, high, table = _tables()
    codeword = words ^ table[low[words & 0xFFF] ^ high[words >> 12]]
    return codeword >> (LENGTH - MESSAGE_BITS)


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """(n, 6) codeword indices near each 23-bit word, -1 where there are fewer.

    The indices are those of the word and of its 23 neighbours. A word within two bits of its
    codeword has one, any other six. Two words at two bits or fewer have a common neighbour (or are
    neighbours), so they always share an index.
    """
    words = np.asarray(words, np.int64)
    flips = np.concatenate([[0], 1 << np.arange(LENGTH)])
    near = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    place = np.cumsum(first, axis=1) - 1
    out = np.full((len(words), 6), -1, np.int64)
    rows, cols = np.nonzero(first)
    out[rows, place[rows, cols]] = near[rows, cols]
    return out

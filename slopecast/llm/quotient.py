"""Counting quotient filters of packed n-grams: an invertible permutation, sorted compact blocks, and their merge."""

from __future__ import annotations

import struct
from collections.abc import Iterable

import numpy as np

#: Odd factors of the mixing steps.
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Entries, quotient bits, and counts that do not fit in a byte.
_HEAD = struct.Struct("<IBI")


def _mixed(rest: np.ndarray) -> np.ndarray:
    """What the words after the first add to the leading word."""
    out = np.zeros(len(rest), np.uint64)
    for k in range(rest.shape[1]):
        x = rest[:, k] + np.uint64(k + 1)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_ODD[k + 1])
        out += x ^ (x >> np.uint64(29))
    return out


def permuted(grams: np.ndarray, bits: int) -> np.ndarray:
    """Leading words that spread the n-grams (rows of word ids below 2 ** bits, bits even) evenly. The other words
    stay as they are, and with them the leading word gives the n-gram back (see restored)."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits // 2)
    x = (grams[:, 0] + _mixed(grams[:, 1:])) & mask
    x = ((x ^ (x >> half)) * np.uint64(_ODD[0])) & mask
    return x ^ (x >> half)


def restored(lead: np.ndarray, rest: np.ndarray, bits: int) -> np.ndarray:
    """The n-grams that leading words and other words stand for."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits // 2)
    inverse = np.uint64(pow(_ODD[0], -1, 1 << bits))
    x = lead ^ (lead >> half)
    x = (x * inverse) & mask
    x = x ^ (x >> half)
    return np.column_stack([(x - _mixed(rest)) & mask, rest])


def counted(lead: np.ndarray, rest: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries in the order of their leading words, with summed counts; sorted runs are merged as such."""
    order = np.argsort(lead, kind="stable")
    a, b = lead[order], rest[order]
    if ((a[1:] == a[:-1]) & (b[1:] != b[:-1]).any(axis=1)).any():  # different n-grams with one leading word
        order = np.lexsort((*rest.T[::-1], lead))
        a, b = lead[order], rest[order]
    new = np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1]).any(axis=1)])
    first = np.flatnonzero(new)
    return a[first], b[first], np.add.reduceat(counts[order], first) if len(first) else counts


def packed(lead: np.ndarray, rest: np.ndarray, counts: np.ndarray, bits: int, above: int) -> bytes:
    """A block of sorted entries that share the `above` top bits of the leading word.

    The next bits, about the logarithm of the entries, are the quotient: a slot bitmap keeps the run of every
    quotient. The rest of the leading word and the other words whole are the remainder, so nothing is lost.
    Counts take a byte, larger ones eight more.
    """
    n = len(lead)
    quotient_bits = min(bits - above, max(1, (n - 1).bit_length()))
    low = bits - above - quotient_bits
    quotient = ((lead & np.uint64((1 << (bits - above)) - 1)) >> np.uint64(low)).astype(np.int64)
    slots = np.zeros((1 << quotient_bits) + n, np.uint8)
    slots[quotient + np.arange(n)] = 1
    remainder = lead.astype("<u8").view(np.uint8).reshape(n, 8)[:, :(low + 7) // 8]
    words = np.ascontiguousarray(rest).astype("<u8").view(np.uint8).reshape(n, -1, 8)[:, :, :bits // 8]
    large = counts[counts >= 255].astype("<u8")
    parts = [np.packbits(slots), np.ascontiguousarray(remainder), np.ascontiguousarray(words), np.minimum(counts, 255).astype(np.uint8), large]
    return _HEAD.pack(n, quotient_bits, len(large)) + b"".join(p.tobytes() for p in parts)


def unpacked(block: bytes, bits: int, above: int, top: int, others: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lead, rest, counts) of a block; top is the value of the `above` top bits, others the words after the first."""
    n, quotient_bits, n_large = _HEAD.unpack_from(block)
    low = bits - above - quotient_bits
    at = _HEAD.size

    def take(size: int) -> np.ndarray:
        nonlocal at
        at += size
        return np.frombuffer(block, np.uint8, size, at - size)

    def widened(data: np.ndarray, rows: int, width: int) -> np.ndarray:
        out = np.zeros((rows, 8), np.uint8)
        out[:, :width] = data.reshape(rows, width)
        return out.view("<u8").reshape(rows).astype(np.uint64)

    size = (1 << quotient_bits) + n
    quotient = np.flatnonzero(np.unpackbits(take((size + 7) // 8), count=size)) - np.arange(n)
    width = (low + 7) // 8
    remainder = widened(take(n * width), n, width) & np.uint64((1 << low) - 1)
    rest = widened(take(n * others * (bits // 8)), n * others, bits // 8).reshape(n, others)
    counts = take(n).astype(np.int64)
    counts[counts == 255] = take(8 * n_large).view("<u8").astype(np.int64)
    lead = remainder | (quotient.astype(np.uint64) << np.uint64(low))
    return (lead | np.uint64(top << (bits - above)) if above else lead), rest, counts


def merged(blocks: Iterable[bytes], bits: int, above: int, top: int, others: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted entries of all blocks of one top value, counts of equal n-grams summed."""
    parts = [unpacked(b, bits, above, top, others) for b in blocks]
    return counted(*[np.concatenate([p[k] for p in parts]) for k in range(3)])

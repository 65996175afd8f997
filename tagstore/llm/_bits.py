"""Vectorised bit packing and reading, most significant bit first."""

import numpy as np

U = np.uint64


def pack(values, lengths):
    """Bytes of the values (uint64, below 2**length) with 0 to 57 bits each, and the bit offset of each; the last byte is filled with 0."""
    lengths = lengths.astype(np.int64)
    pos = np.cumsum(lengths) - lengths
    total = int(pos[-1] + lengths[-1]) if len(pos) else 0
    words = np.zeros((total >> 6) + 2, U)
    if len(pos):
        word, shift = pos >> 6, 64 - (pos & 63) - lengths
        fits = shift >= 0
        part = np.where(fits, values << np.maximum(shift, 0).astype(U), values >> np.maximum(-shift, 0).astype(U))
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        words[word[first]] += np.add.reduceat(part, first)
        over = np.flatnonzero(~fits)
        words[word[over] + 1] += values[over] << (64 + shift[over]).astype(U)
    return words.astype(">u8").tobytes()[: (total + 7) >> 3], pos


def as_words(data):
    """Big-endian 64-bit words of data, with two spare words behind."""
    return np.frombuffer(bytes(data) + b"\0" * (16 + -len(data) % 8), ">u8").astype(U)


def peek(words, pos):
    """The 64 bits from each bit position on."""
    at, off = pos >> 6, (pos & 63).astype(U)
    return (words[at] << off) | ((words[at + 1] >> U(1)) >> (U(63) - off))


_LEADING = np.array([16 - int(x).bit_length() for x in range(1 << 16)], np.int64)


def leading_zeros(x):
    """Leading zeros of 64-bit numbers."""
    n = _LEADING[(x >> U(48)).astype(np.int64)]
    more = np.flatnonzero(n == 16)
    step = 32
    while len(more) and step >= 0:
        part = _LEADING[((x[more] >> U(step)) & U(0xFFFF)).astype(np.int64)]
        n[more] += part
        more = more[part == 16]
        step -= 16
    return n

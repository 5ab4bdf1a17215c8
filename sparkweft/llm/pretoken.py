"""Vectorised splitting of text into the pieces that BPE works on.

A text is an array of code points. Each gets a class from a table, runs of one
class are found by comparing neighbours, and the few rules that look beyond a
run (a space before a word, the last of several spaces, contractions) are
applied to arrays of runs. Pieces are then numbered by a 64-bit hash, so that
each distinct piece of a chunk is encoded once.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: Code points whose classes are asked for at once; surrogates are whole runs of so many.
ASKED = 0x800
_A = np.uint64(0x9E3779B97F4A7C15)
_PRIME = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, by the character classes that the split patterns name.

    They are taken from the tokenizers library's own pattern engine, whose
    Unicode version may be newer than the host language's.
    """
    from tokenizers import Regex, pre_tokenizers

    table = np.zeros(0x110000, np.uint8)
    split = [(kind, pre_tokenizers.Split(Regex(pattern), "removed", invert=True)) for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+"))]
    # Asked for all code points at once, the library takes 250 MB, in each worker.
    for first in range(0, 0x110000, ASKED):
        if not 0xD800 <= first < 0xE000:
            every = "".join(map(chr, range(first, first + ASKED)))
            for kind, by in split:
                for _, (s, e) in by.pre_tokenize_str(every):
                    table[first + s : first + e] = kind
    return table


@lru_cache(1)
def unassigned() -> np.ndarray:
    """Code points that the host language's Unicode version does not know."""
    import unicodedata

    return np.array([unicodedata.category(chr(i)) == "Cn" for i in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _contractions(cp: np.ndarray, start: np.ndarray, kind: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each run: letters of the contraction that it and the next run begin, else 0.

    Fixed values: 's 't 're 've 'm 'll 'd.
    """
    out = np.zeros(len(start), np.int64)
    q = np.flatnonzero((kind == OTHER) & (end - start == 1) & (cp[start] == 39))
    q = q[q + 1 < len(start)]
    q = q[kind[q + 1] == LETTER]
    if not len(q):
        return out
    s, n = start[q + 1], end[q + 1] - start[q + 1]
    a = cp[s]
    b = np.where(n > 1, cp[np.minimum(s + 1, len(cp) - 1)], 0)
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    one = np.isin(a, [ord(c) for c in "stmd"])
    out[q] = np.where(two, 2, np.where(one, 1, 0))
    return out


def spans(cp: np.ndarray, limits: np.ndarray, keep_spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each piece of the texts that lie one after another in ``cp``, cut at ``limits``.

    keep_spaces: the byte-level rule, in which every character is in a piece
    and a word takes the space before it. Otherwise white space goes and each
    number character is a piece.
    """
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = classes()[cp]
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    new[limits[:-1][limits[:-1] < n]] = True
    if not keep_spaces:
        new |= kind == NUMBER
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    k = kind[start]
    first = np.zeros(len(start), bool)  # runs that begin a text
    first[np.searchsorted(start, limits[:-1][limits[:-1] < n])] = True
    spaced = np.zeros(len(start), bool)
    if keep_spaces:
        spaced[1:] = (k[:-1] == SPACE) & ~first[1:] & (k[1:] != SPACE) & (cp[start[1:] - 1] == 32)
    cut = _contractions(cp, start, k, end)
    cut[:-1][first[1:]] = 0
    cut[spaced] = 0
    s, e = start.copy(), end.copy()
    s[spaced] -= 1
    after = np.zeros(len(start), np.int64)
    after[1:] = cut[:-1]
    s += after  # letters that a contraction took
    e += cut
    if not keep_spaces:
        keep = (k != SPACE) & (s < e)
        return s[keep], e[keep]
    extra_s = extra_e = np.zeros(0, np.int64)
    white = np.flatnonzero(k == SPACE)
    if len(white):
        follows = np.zeros(len(white), bool)
        inner = white + 1 < len(start)
        follows[inner] = ~first[white[inner] + 1]
        last_plain = np.zeros(len(white), bool)  # the last character stays alone: it is no plain space
        last_plain[follows] = ~spaced[white[follows] + 1]
        e[white[follows]] -= 1
        alone = white[last_plain]
        extra_s, extra_e = end[alone] - 1, end[alone]
    keep = s < e
    s, e = np.concatenate([s[keep], extra_s]), np.concatenate([e[keep], extra_e])
    order = np.argsort(s, kind="stable") if len(extra_s) else slice(None)
    return s[order], e[order]


_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(_PRIME), -1, 1 << 64))
        make = lambda x: np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(size - 1, x, np.uint64))])
        _powers = make(_PRIME), make(inverse)
    return _powers


def span_hashes(cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each piece, from prefix sums; the values are mixed before they are summed."""
    up, down = _power_tables(len(cp) + 1)
    v = cp.astype(np.uint64) + np.uint64(1)
    v *= _A
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(32)
    v *= up[: len(cp)]
    total = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(v, out=total[1:])
    h = (total[e] - total[s]) * down[s]
    h ^= (e - s).astype(np.uint64) << np.uint64(48)
    h ^= h >> np.uint64(31)
    return h * np.uint64(0x94D049BB133111EB)


def distinct(cp: np.ndarray, text: str, s: np.ndarray, e: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct pieces and, for each piece, which one it is.

    ``text`` has a character for each code point.
    """
    _, at, which = np.unique(span_hashes(cp, s, e), return_index=True, return_inverse=True)
    return [text[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)], which


def ragged_gather(flat: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of the chosen rows of a ragged table one after another, and the row lengths."""
    lengths = offsets[which + 1] - offsets[which]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(offsets[which] - (ends - lengths), lengths)
    return flat[index], lengths

"""Vectorised DNA kernels: two-bit k-mer codes and canonical minimizers.

Codes are A 0, C 1, G 2, T 3; upper and lower case are one, every other letter is ambiguous. A k-mer's key is the
smaller of its own code and that of its reverse complement, read as an unsigned number of 2k bits, so k is at most 16
for keys that fit 32 bits. The order of k-mers is `kmer_order`, a plain 32-bit mix that SQL can compute as well.
"""

from __future__ import annotations

import numpy as np

AMBIGUOUS = 4
# Odd multipliers of the 32-bit mix.
MULTIPLIERS = (0x2C1B3C6D, 0x297A2D39)

_BASES = np.full(256, AMBIGUOUS, np.uint8)
for _code, _letters in enumerate(("Aa", "Cc", "Gg", "Tt")):
    _BASES[[ord(x) for x in _letters]] = _code


def base_codes(sequence: str | bytes) -> np.ndarray:
    data = sequence.encode("ascii", "replace") if isinstance(sequence, str) else sequence
    return _BASES[np.frombuffer(data, np.uint8)]


def kmer_order(key: np.ndarray, seed: int) -> np.ndarray:
    """32-bit arithmetic throughout, which wraps around."""
    x = key + np.uint32(seed)
    x ^= x >> np.uint32(16)
    x *= np.uint32(MULTIPLIERS[0])
    x ^= x >> np.uint32(15)
    x *= np.uint32(MULTIPLIERS[1])
    x ^= x >> np.uint32(16)
    return x


def kmer_keys(codes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Code of every k-mer and of its reverse complement, 32 bits each; ambiguous letters read as A."""
    n = len(codes) - k + 1
    letters = np.where(codes == AMBIGUOUS, 0, codes).astype(np.uint32)
    forward, backward = np.zeros(max(n, 0), np.uint32), np.zeros(max(n, 0), np.uint32)
    for j in range(k if n > 0 else 0):
        forward <<= np.uint32(2)
        forward |= letters[j : j + n]
        backward |= (np.uint32(3) - letters[j : j + n]) << np.uint32(2 * j)
    return forward, backward


#: Letters whose windows are looked at together; bounds the memory that a long sequence takes.
PART = 500_000


def window_choices(codes: np.ndarray, k: int, w: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows, chosen, keys, own): the windows of w k-mers without an ambiguous letter, the position of the k-mer that
    each chooses, that k-mer's key, and whether it is its own reverse complement.

    The k-mer that is first by `kmer_order` is chosen; among equals the leftmost where the window has more G and T
    than not, else the rightmost, so that both strands choose alike if k + w - 1 is odd.
    """
    width = k + w - 1
    windows = len(codes) - width + 1
    nothing = np.zeros(0, np.int64)
    if windows < 1:
        return nothing, nothing, nothing, np.zeros(0, bool)
    unclear = np.r_[0, np.cumsum(codes == AMBIGUOUS, dtype=np.int32)]
    clear = np.flatnonzero(unclear[width:] == unclear[:-width])
    if not len(clear):
        return nothing, nothing, nothing, np.zeros(0, bool)
    forward, backward = kmer_keys(codes, k)
    keys = np.minimum(forward, backward)
    order = kmer_order(keys, seed)
    heavy = np.r_[0, np.cumsum((codes == 2) | (codes == 3), dtype=np.int32)]
    left = (2 * (heavy[width:] - heavy[:-width]) > width)[:windows]
    best, at = order[:windows].copy(), np.zeros(windows, np.int32)
    for j in range(1, w):
        other = order[j : j + windows]
        better = (other < best) | ((other == best) & ~left)
        np.copyto(best, other, where=better)
        np.copyto(at, j, where=better)
    chosen = clear + at[clear]
    return clear, chosen, keys[chosen].astype(np.int64), forward[chosen] == backward[chosen]


def minimizers(codes: np.ndarray, k: int, w: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the canonical minimizers, in window order.

    A k-mer that consecutive windows choose counts once; one that is its own reverse complement is then dropped.
    """
    width, last, found = k + w - 1, -1, []
    for start in range(0, max(1, len(codes) - width + 1), PART):
        _, chosen, keys, own = window_choices(codes[start : start + PART + width - 1], k, w, seed)
        if len(chosen):
            chosen = chosen + start
            new = np.r_[chosen[0] != last, chosen[1:] != chosen[:-1]]
            last = chosen[-1]
            found.append((chosen[new & ~own], keys[new & ~own]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def joined_codes(sequences: list[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The codes of all sequences with an ambiguous letter, which no window reaches over, behind each; their starts."""
    codes = [base_codes(s or b"") for s in sequences]
    gap = np.full(1, AMBIGUOUS, np.uint8)
    starts = np.cumsum([0, *[len(c) + 1 for c in codes]])
    return (np.concatenate([x for c in codes for x in (c, gap)]) if codes else gap), starts


def minimizers_of_all(sequences: list[str | bytes | None], k: int, w: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence number, position, key) of the minimizers of many sequences at once; null has none."""
    joined, starts = joined_codes(sequences)
    positions, keys = minimizers(joined, k, w, seed)
    owner = np.searchsorted(starts, positions, side="right") - 1
    return owner, positions - starts[owner], keys


def sketches_of_ranges(codes: np.ndarray, start: np.ndarray, end: np.ndarray, k: int, w: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(range number, key): the distinct minimizer keys of each range of a sequence, ascending; ranges ascend by start.

    Windows are looked at once however many ranges they lie in; ranges are taken together up to PART letters.
    """
    width, at, found = k + w - 1, 0, []
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(start, start[at] + PART)))
        base, stop = int(start[at]), int(end[at:upto].max())
        windows, chosen, keys, own = window_choices(codes[base:stop], k, w, seed)
        first = np.searchsorted(windows, start[at:upto] - base)
        count = np.maximum(np.searchsorted(windows, end[at:upto] - base - width, side="right") - first, 0)
        owner = np.repeat(np.arange(at, upto), count)
        which = np.repeat(first, count) + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        # a k-mer is chosen by about w windows in a row: keep one before sorting
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (chosen[which[1:]] != chosen[which[:-1]])
        new &= ~own[which] if len(which) else True
        owner, key = owner[new], keys[which[new]]
        order = np.lexsort((key, owner))
        owner, key = owner[order], key[order]
        if len(key):
            distinct = np.r_[True, (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])]
            found.append((owner[distinct], key[distinct]))
        at = upto
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])

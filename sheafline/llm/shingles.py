"""Word shingles of texts as sets of 64-bit hashes, and min-max signatures of them, by array operations."""

from __future__ import annotations

import numpy as np

# The white space of the contracts.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def constants(n: int, salt: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)) | np.uint64(1)


_PLACE = constants(64, 11)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and how many each text has."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    inside = ~_SPACE[raw]
    edge = np.diff(inside.view(np.int8))
    first, end = np.nonzero(edge == 1)[0] + 1, np.nonzero(edge == -1)[0] + 1
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    per_text = np.diff(np.searchsorted(first, begins))
    if not len(first):
        return np.zeros(0, np.uint64), per_text
    size = end - first
    head = np.cumsum(size) - size
    local = np.arange(head[-1] + size[-1]) - np.repeat(head, size)
    at = local + np.repeat(first, size)
    with np.errstate(over="ignore"):
        place = _PLACE[local & 63] if local.max() < 64 else mix64(local.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
        if local.max() >= 64:  # the same factors for short words whatever else is in the batch
            place = np.where(local < 64, _PLACE[local & 63], place)
        h = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * place, head)
        return mix64(h + size.astype(np.uint64)), per_text


def sets_of(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text (lower-cased UTF-8)."""
    h, per_text = words_of(texts)
    coef = constants(n, 77)
    out, at = [], 0
    with np.errstate(over="ignore"):
        run = len(h) - n + 1
        whole = mix64(sum(h[i : i + run] * coef[i] for i in range(n))) if run > 0 else np.zeros(0, np.uint64)
        for k in per_text.tolist():
            if k >= n:
                out.append(np.unique(whole[at : at + k - n + 1]))
            elif k:
                out.append(mix64(np.array([sum(h[at + i] * coef[i] for i in range(k)) + np.uint64(k)], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
            at += k
    return out


def lowered(text: str | None) -> bytes:
    """UTF-8 with A-Z lower-cased and nothing else."""
    return b"" if text is None else text.encode("utf-8", "replace").lower()


def min_max(sets: list[np.ndarray], permutations: int) -> np.ndarray:
    """One row per non-empty set: the least and greatest value under each permutation, side by side."""
    full = np.concatenate(sets)
    size = np.array(list(map(len, sets)))
    head = np.cumsum(size) - size
    a, b = constants(permutations, 123), constants(permutations, 456)
    out = np.empty((len(sets), 2 * permutations), np.uint64)
    with np.errstate(over="ignore"):
        for p in range(permutations):
            v = full * a[p] + b[p]
            out[:, 2 * p] = np.minimum.reduceat(v, head)
            out[:, 2 * p + 1] = np.maximum.reduceat(v, head)
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys of bands of so many values. A band takes values far apart, so that both values of one permutation,
    which depend on each other a little, do not share a band."""
    bands = signatures.shape[1] // rows
    with np.errstate(over="ignore"):
        keys = np.zeros((len(signatures), bands), np.uint64)
        for r in range(rows):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + signatures[:, r * bands : (r + 1) * bands])
        return mix64(keys + np.arange(bands, dtype=np.uint64)[None, :])


def set_digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set: equal for equal sets."""
    with np.errstate(over="ignore"):
        x = np.sum(mix64(s + np.uint64(0x1234567)), dtype=np.uint64) + np.uint64(len(s))
        y = np.sum(mix64(s * np.uint64(0xD6E8FEB86659FD93) + np.uint64(99)), dtype=np.uint64)
    return int(x.astype(np.int64)), int(y.astype(np.int64))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())

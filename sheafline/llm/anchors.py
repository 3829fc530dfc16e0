"""Content-chosen anchors of byte strings: which windows of a text can have an equal elsewhere.

A window of ``length`` bytes is represented by its anchor, the k-gram in it with the least hash (leftmost of equals), so
equal windows have equal anchors at equal offsets. Consecutive windows with one anchor make a stretch; its context is
every byte its windows cover. Hashes of all k-grams and contexts come from one running sum per batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .shingles import constants, mix64

_BYTE = constants(256, 991)
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
MOST = 1 << 20  # places that fit beside a hash


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.ones(n, np.uint64)
        if n > 1:
            out[1:] = np.uint64(base)
            np.multiply.accumulate(out, out=out)
        return out


@dataclass
class Stretches:
    """Columns: text number, first window, number of windows, offset of the anchor in the context, hash of the anchor and
    of the context."""

    text: np.ndarray
    start: np.ndarray
    count: np.ndarray
    offset: np.ndarray
    anchor: np.ndarray
    context: np.ndarray


def _part(raw: np.ndarray, length: int, k: int, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, ...]:
    n = len(raw)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
        gram = mix64((total[k:] - total[:-k]) * down[: n - k + 1])
        key = (gram & ~np.uint64(MOST - 1)) | np.arange(len(gram), dtype=np.uint64)
        width, done = length - k + 1, 1
        while done < width:  # least over ever wider windows
            step = min(done, width - done)
            key = np.minimum(key[:-step], key[step:])
            done += step
        at = (key & np.uint64(MOST - 1)).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(np.diff(at))[0] + 1])
        count = np.diff(np.append(first, len(at)))
        place = at[first]
        end = first + count - 1 + length
        context = mix64((total[end] - total[first]) * down[first] + np.uint64(0x51ED27) * (place - first).astype(np.uint64) + count.astype(np.uint64))
    return first, count, place - first, gram[place], context


def stretches(texts: list[bytes], length: int, k: int) -> Stretches:
    """The stretches of all texts of at least length bytes."""
    parts = []
    longest = min(MOST // 2, max(map(len, texts), default=0))
    up, down = powers(_P, longest), powers(_P_INV, longest)
    for i, t in enumerate(texts):
        raw = np.frombuffer(t, np.uint8)
        a = 0
        while len(raw) - a >= length:  # very long texts in overlapping pieces; a stretch cut in two stays two
            piece = raw[a : a + longest]
            first, count, offset, anchor, context = _part(piece, length, k, up, down)
            parts.append((np.full(len(first), i), first + a, count, offset, anchor, context))
            if a + len(piece) >= len(raw):
                break
            a += len(piece) - length + 1
    if not parts:
        z = np.zeros(0, np.int64)
        return Stretches(z, z, z, z, z.astype(np.uint64), z.astype(np.uint64))
    return Stretches(*(np.concatenate(c) for c in zip(*parts, strict=True)))


def window_prints(raw: np.ndarray, at: np.ndarray, count: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of count windows of length bytes from each place of raw."""
    size = count + length - 1
    head = np.cumsum(size) - size
    parts, a = [], 0
    while a < len(at):  # about a million bytes at a time
        z = max(a + 1, int(np.searchsorted(head, head[a] + MOST, side="right")) - 1) if head[-1] - head[a] > MOST else len(at)
        n = size[a:z]
        own = np.cumsum(n) - n
        picked = raw[np.arange(int(n.sum())) - np.repeat(own, n) + np.repeat(at[a:z], n)]
        up, down = powers(_P, len(picked)), powers(_P_INV, len(picked))
        with np.errstate(over="ignore"):
            total = np.zeros(len(picked) + 1, np.uint64)
            np.cumsum(_BYTE[picked] * up, out=total[1:])
            first = np.arange(int(count[a:z].sum())) - np.repeat(np.cumsum(count[a:z]) - count[a:z], count[a:z]) + np.repeat(own, count[a:z])
            parts.append(mix64((total[first + length] - total[first]) * down[first]))
        a = z
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)

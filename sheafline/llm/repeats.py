"""Removal of long byte strings that occur earlier, by merging Burrows-Wheeler transforms of shards.

Candidates. Anchors (see ``anchors``) name, for every window of ``length`` bytes, a k-gram in it; only windows with the
same anchor can be equal. Fingerprints (64 bits) of the contexts of anchors choose the text that is compared: contexts
met twice, and, where an anchor has several contexts, single windows met twice. Fingerprints remove nothing.

Units. What has one fingerprint is compared with its first occurrence (smallest doc_id, then start), in units of some
sixteen other documents and 32 kB of the first's text, so a passage of any number of documents makes many small units. Map
tasks compare what they meet twice themselves and send the first only, so a fingerprint has one row per map task; contexts
of an anchor that has many in one task are dealt by window, not by anchor. No unit or bucket grows with a hot key.

Decision. A unit's texts are strings over letters of up to twenty bytes (one string for each offset, so every window is a
suffix). They are cut into shards, each shard's Burrows-Wheeler transform is built on its own, and the transforms are
merged by iterative interleave refinement: the interleave after h rounds orders all suffixes by their first h letters,
each round is one stable partition by the transforms' letters, and the round in which a border between neighbours appears
is their common prefix plus one. No suffix of the union is sorted again. Suffixes without a border between them after
length bytes are the repeated intervals; in each the window with the smallest (doc_id, start) stays and the others are
marked. Every mark comes from a merged interval. A byte is removed if a marked window covers it.

Cases. Null text counts as empty. Texts shorter than length lose nothing. Windows never cross documents; overlapping
repeats within one document count. Rows that repeat a doc_id count as one document with the least of their texts; each
row gets its result. Rows with a null doc_id take no part and are returned whole. An empty table gives an empty result.
Columns other than doc_id and text are ignored by ``spans_removed``. Equal windows always have equal fingerprints, so a
collision costs time and changes no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import stretches, window_prints
from .common import materialise
from .shingles import mix64


@dataclass(frozen=True)
class RepeatSpec:
    """length of a repeat; k: bytes of an anchor; shards of a merge; bytes of text per bucket, map step and hashing step;
    documents and bytes of the first occurrence per unit; letters per merge; contexts of one anchor in a map step from
    which its windows are dealt one by one; most tasks of a step."""

    length: int = 100
    k: int = 56
    shards: int = 4
    bucket_bytes: int = 8 << 20
    map_bytes: int = 8 << 20
    batch_bytes: int = 1 << 20
    unit_docs: int = 16
    unit_bytes: int = 1 << 15
    merge_letters: int = 1 << 19
    hot: int = 8
    most_tasks: int = 100_000


# -- merging transforms

def _order(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (major, minor), both below 2^32, and the dense rank, from 0, of each element. Keys that leave room for the
    place in one number are sorted with it."""
    bits, own = int(minor.max(initial=0)).bit_length(), len(major).bit_length()
    if int(major.max(initial=0)).bit_length() + bits + own <= 63:
        key = major.astype(np.int64)
        key <<= bits
        key |= minor
        key <<= own
        key |= np.arange(len(key))
        key = key.view(np.uint64)
        key.sort()
        order = (key & np.uint64((1 << own) - 1)).astype(np.int32)
        key >>= np.uint64(own)
    else:
        key = (major.astype(np.uint64) << np.uint64(bits)) | minor.astype(np.uint64)
        order = np.argsort(key).astype(np.int32)
        key = key[order]
    new = np.zeros(len(key), np.int32)
    np.not_equal(key[1:], key[:-1], out=new[1:], casting="unsafe")
    rank = np.empty(len(key), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32)
    return order, rank


def letters_of(raw: np.ndarray, size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of strings laid end to end, size + 1 each: (string, place in it, letter). The letter of a place is the rank,
    from 1, of the width bytes there; 0 where fewer are left, which ends one of the string's width offsets."""
    who = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
    place = np.arange(len(who), dtype=np.int32) - np.repeat((np.cumsum(size + 1) - size - 1).astype(np.int32), size + 1)
    letter = np.zeros(len(who), np.int32)
    n = len(raw) - width + 1
    if n > 0:
        # Ranks of the first bytes, of twice as many, ...; places beyond the last whole letter are never used.
        done = next(w for w in range(min(5, width), 0, -1) if width % w == 0)
        word = np.zeros(len(raw) - done + 1, np.int64)
        for i in range(done):
            word = (word << 8) | raw[i : i + len(word)]
        ranks = {done: _order(word >> 24, word & 0xFFFFFF)[1]}
        while done < width:
            step = done if 2 * done <= width else max(x for x in ranks if x <= width - done)
            own = len(raw) - done - step + 1
            ranks[done + step] = _order(ranks[done][:own], ranks[step][done : done + own])[1]
            done += step
        whole = np.nonzero(size[who] - place >= width)[0]
        letter[whole] = ranks[width][whole - who[whole]] + 1
    return who, place, letter


def transform(slots: np.ndarray, room: np.ndarray, letter: np.ndarray, width: int, depth: int, space: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Slots of one shard in the order of their first depth letters. room: slots from each to its string's last. Ranks of
    1, 2, 4, ... letters are joined; the transform's own letters are those width places before each slot. space: arrays as
    long as letter that shards may share."""
    space = {} if space is None else space
    ranks, own, done, order = {1: letter}, letter[slots], 1, None
    while done < depth:
        n = done if 2 * done <= depth else max(x for x in ranks if x <= depth - done)
        on = np.nonzero(room[slots] >= done * width)[0]
        after = np.zeros(len(slots), np.int32)  # the rank, from 1, of what stands done letters on; 0 beyond the string
        after[on] = ranks[n][slots[on] + done * width]
        after[on] += 1
        order, own = _order(own, after)
        done += n
        if done < depth:
            ranks[done] = space.setdefault(done, np.empty(len(letter), np.int32))
            ranks[done][slots] = own
    return slots[np.argsort(own, kind="stable") if order is None else order]


def merge(order: np.ndarray, before: np.ndarray, back: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of transforms after depth rounds, and common prefixes of neighbours (depth where no border is).

    The transforms are laid end to end: order holds their slots, before the letter before each (0: none), back the place
    of the suffix longer by that letter. ends: the places of the empty suffixes, which differ from each other and stay
    first. The first result is, for each rank in the merged order, the slot there.
    """
    place, common = np.arange(len(order), dtype=np.int32), np.full(len(order), depth, np.int32)
    block = np.zeros(len(order), np.int32)
    common[:1] = 0
    own = len(order).bit_length()
    before, back, ends = before.astype(np.uint64) << np.uint64(own), back.astype(np.int32), ends.astype(np.int32)
    low = np.uint64((1 << own) - 1)
    for h in range(depth):
        letter = before[place]
        on = np.nonzero(letter)[0]
        key = letter[on] | on.astype(np.uint64)
        key.sort()  # a stable partition by the letter: equal letters keep the order of the interleave
        at = (key & low).astype(np.int32)
        key >>= np.uint64(own)
        came = block[at]
        border = np.ones(len(order), bool)
        border[len(ends) + 1 :] = (came[1:] != came[:-1]) | (key[1:] != key[:-1])
        place = np.concatenate([ends, back[place[at]]])
        common[border & (common == depth)] = h
        block = np.cumsum(common < depth, dtype=np.int32)
    return order[place], common


def repeated(raw: np.ndarray, size: np.ndarray, shard: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, start, interval, slot) of every window of length bytes that occurs more than once in strings laid end to
    end, by merging the transforms of their shards; intervals are numbered in order."""
    width = max(w for w in range(1, 21) if length % w == 0)
    depth = length // width
    who, place, letter = letters_of(raw, size, width)
    room, shards, space = size.astype(np.int32)[who] - place, shard.astype(np.int32)[who], {}
    order = np.concatenate([transform(np.nonzero(shards == s)[0].astype(np.int32), room, letter, width, depth, space) for s in np.unique(shard)])
    where = np.empty(len(order), np.int32)
    where[order] = np.arange(len(order), dtype=np.int32)
    inner = np.nonzero(place[order] >= width)[0]
    left = order[inner] - width
    before, back = np.zeros(len(order), np.int32), np.zeros(len(order), np.int32)
    before[inner], back[inner] = letter[left], where[left]
    slots, common = merge(order, before, back, np.nonzero(letter[order] == 0)[0], depth)
    interval = np.cumsum(common < depth)
    many = np.bincount(interval)[interval] > 1
    slots = slots[many]
    return who[slots], place[slots], interval[many], slots


# -- units: rows (unit, doc, first window, windows)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0] ... start[0] + size[0] - 1, start[1] ... laid end to end."""
    head = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(head, size) + np.repeat(start, size)


def _runs(unit: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows with those of one unit and document that touch joined, in order."""
    start, count = start.astype(np.int64), count.astype(np.int64)
    if not len(doc):
        return unit, doc, start, count
    o = np.lexsort((start, doc, unit))
    unit, doc, start, end = unit[o], doc[o], start[o], (start + count)[o]
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (unit[1:] != unit[:-1])]
    # Documents laid one after the other, so that the greatest end so far is one running maximum.
    base = (np.cumsum(fresh) - 1) * (int(end.max()) + 2)
    fresh[1:] |= (start + base)[1:] > np.maximum.accumulate(end + base)[:-1]
    first = np.nonzero(fresh)[0]
    return unit[first], doc[first], start[first], np.maximum.reduceat(end, first) - start[first]


def _doc_key(doc: np.ndarray) -> np.ndarray:
    return mix64(doc.astype(np.uint64)) >> np.uint64(8)


def _firsts(key: np.ndarray, doc: np.ndarray | None = None, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of (key, doc, start), and which of them begin a new value of the key. Without doc and start the
    rows are in their order."""
    o = np.arange(len(key)) if doc is None else np.lexsort((start, doc))
    o = o[np.argsort(key[o], kind="stable")]
    return o, np.r_[True, key[o][1:] != key[o][:-1]][: len(o)]


def _units(o: np.ndarray, new: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, spec: RepeatSpec) -> tuple[np.ndarray, ...]:
    """Rows that set the later occurrences of each value (see ``_firsts``) beside its first."""
    value = np.cumsum(new) - 1
    m = np.bincount(value, minlength=1)
    late = np.nonzero(~new)[0]
    own, first = o[late], o[new][value[late]]
    # About unit_docs documents meet a first in one unit; a document's share is the same for all values with like counts.
    groups = np.exp2(np.ceil(np.log2(np.maximum(1, m[value[late]] / spec.unit_docs)))).astype(np.uint64)
    with np.errstate(over="ignore"):
        group = mix64(doc[own].astype(np.uint64) + np.uint64(0x9E37)) & (groups - np.uint64(1))
        segment = (start[first].astype(np.int64) // spec.unit_bytes).astype(np.uint64)
        unit = mix64(mix64(doc[first].astype(np.uint64) + np.uint64(77)) ^ mix64(segment + (group << np.uint64(24)))) >> np.uint64(1)
    both = np.concatenate([own, first])
    return _runs(np.concatenate([unit, unit]), doc[both], start[both], count[both])


def _late_windows(unit: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, at: np.ndarray, raw: np.ndarray, spec: RepeatSpec) -> tuple[np.ndarray, ...]:
    """Marks (doc, first window, windows) among the rows of units: windows that occur earlier. at: where in raw a row's
    bytes begin. Units are taken together up to merge_letters."""
    o = np.argsort(unit, kind="stable")
    total = np.r_[0, np.cumsum(count[o] + spec.length - 1)]
    ends = np.nonzero(np.r_[unit[o][1:] != unit[o][:-1], True])[0] + 1 if len(o) else []
    marks, a = [], 0
    for i, z in enumerate(ends):
        if i + 1 < len(ends) and total[ends[i + 1]] - total[a] <= spec.merge_letters:
            continue
        own = o[a:z]
        own = own[np.lexsort((start[own], doc[own]))]
        n = count[own] + spec.length - 1
        w, p, interval, slot = repeated(raw[_ranges(at[own], n)], n, np.arange(len(own)) % spec.shards, spec.length)
        a = z
        if not len(w):
            continue
        # Strings are in the order of their documents and starts, so an interval's least slot is the first occurrence. A
        # window that stands in several rows of one document is one occurrence.
        head = np.nonzero(np.r_[True, interval[1:] != interval[:-1]])[0]
        lead = np.repeat(np.minimum.reduceat(slot, head), np.diff(np.r_[head, len(slot)]))
        late = np.zeros(int(n.sum()) + len(n) + 1, bool)
        d, s = doc[own], start[own]
        who = np.repeat(np.arange(len(n)), n + 1)
        first = np.cumsum(n + 1) - n - 1
        lw = who[lead]
        late[slot] = (d[w] != d[lw]) | (s[w] + p != s[lw] + lead - first[lw])
        edge = np.diff(np.r_[False, late].astype(np.int8))  # the last slot of a string is no window, so runs end in it
        x, y = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
        marks.append((d[who[x]], s[who[x]] + x - first[who[x]], y - x))
    if not marks:
        return doc[:0], start[:0], count[:0]
    d, s, c = (np.concatenate(x) for x in zip(*marks, strict=True))
    return _runs(np.zeros(len(d), np.uint64), d, s, c)[1:]


# -- transport: columns packed for one bucket


def _pack(*columns: np.ndarray) -> bytes:
    raw = b"".join(len(c).to_bytes(8, "little") + c.dtype.str.encode().ljust(4) + c.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 8], "little"), np.dtype(raw[at + 8 : at + 12].decode().strip())
        at += 12
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


def _deal(key: np.ndarray, buckets: int, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A packed blob for each bucket that has rows."""
    to = (key % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    for at in np.split(order, np.nonzero(np.diff(to[order]))[0] + 1) if len(order) else []:
        yield int(to[at[0]]), _pack(*[c[at] for c in columns])


def _tasks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Ids and texts, about most bytes at a time."""
    ids, texts, total = [], [], 0
    for batch in batches:
        names = batch.schema.names
        for i, t in zip(batch.column(names.index("doc_id")).to_pylist(), batch.column(names.index("text")).to_pylist(), strict=True):
            ids.append(i)
            texts.append((t or "").encode("utf-8", "replace"))
            total += len(texts[-1])
            if total >= most:
                yield np.array(ids, np.int64), texts
                ids, texts, total = [], [], 0
    if ids:
        yield np.array(ids, np.int64), texts


ROW = "bucket int, kind int, blob binary"
#: What a blob holds. ENTRY: contexts, to their anchor's bucket. HOT: anchors dealt by window. WINDOW: single windows, to
#: their fingerprint's bucket. WANTED, SOUGHT: rows of units and contexts, to their text's bucket. UNIT: rows with their
#: bytes, to the unit's bucket. MARK: marks, to their text's bucket. TEXT: texts.
ENTRY, HOT, WINDOW, WANTED, SOUGHT, UNIT, MARK, TEXT = range(8)


class Out:
    """Rows of one step."""

    def __init__(self, buckets: int):
        self.buckets, self.rows = buckets, []

    def deal(self, kind: int, key: np.ndarray, *columns: np.ndarray) -> None:
        if len(key):
            self.rows += [(b, kind, blob) for b, blob in _deal(key, self.buckets, *columns)]

    def marks(self, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        self.deal(MARK, _doc_key(doc), doc, start.astype(np.uint32), count.astype(np.uint32))

    def wanted(self, unit: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> None:
        self.deal(WANTED, _doc_key(doc), unit, doc, start.astype(np.uint32), count.astype(np.uint32))

    def windows(self, prints: np.ndarray, doc: np.ndarray, start: np.ndarray) -> None:
        self.deal(WINDOW, prints >> np.uint64(20), prints, doc, start.astype(np.uint32))

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in self.rows], k) for i, k in enumerate(kinds)], names=["bucket", "kind", "blob"])

    def table(self) -> pa.Table:
        return pa.Table.from_batches([self.batch()])


def _read(t: pa.Table, kind: int, *empty: type) -> list[np.ndarray]:
    """The columns of all blobs of a kind, end to end; of the given types where there are none."""
    blobs = [b for k, b in zip(t.column("kind").to_pylist(), t.column("blob").to_pylist(), strict=True) if k == kind]
    return [np.concatenate(c) for c in zip(*map(_unpack, blobs), strict=True)] if blobs else [np.zeros(0, x) for x in empty]


def _single_windows(raw: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, out: Out, spec: RepeatSpec) -> tuple[np.ndarray, ...]:
    """Deals the first occurrence of each window of the given contexts; returns rows of units for the others."""
    prints = window_prints(raw, at, count, spec.length)
    d, s = np.repeat(doc, count), _ranges(start, count)
    o, new = _firsts(prints, d, s)
    first = o[new]
    out.windows(prints[first], d[first], s[first])
    return _units(o, new, d, s, np.ones(len(d), np.int64), spec)


def _found(ids: np.ndarray, texts: list[bytes], out: Out, spec: RepeatSpec) -> None:
    """Contexts of a map task's texts: what it meets twice is compared here, the first goes to its anchor."""
    order = np.argsort(ids, kind="stable")
    ids, texts = ids[order], [texts[i] for i in order]
    parts, a = [], 0
    while a < len(texts):
        z, size = a, 0
        while z < len(texts) and (z == a or size + len(texts[z]) <= spec.batch_bytes):
            size += len(texts[z])
            z += 1
        s = stretches(texts[a:z], spec.length, spec.k)
        parts.append((s.text + a, s.start, s.count, s.anchor, s.context))
        a = z
    doc, start, count, anchors, context = (np.concatenate(c) for c in zip(*parts, strict=True))  # doc: number of the text
    if not len(doc):
        return
    head = np.cumsum([0] + list(map(len, texts)))
    raw = np.frombuffer(b"".join(texts), np.uint8)
    o, new = _firsts(context)
    met = [_units(o, new, ids[doc], start, count, spec)]
    fresh = o[new]
    _, of, contexts = np.unique(anchors[fresh], return_inverse=True, return_counts=True)
    many = contexts[of] >= spec.hot
    hot, rest = fresh[many], np.sort(fresh[~many])
    out.deal(ENTRY, anchors[rest] >> np.uint64(20), anchors[rest], context[rest], ids[doc[rest]], start[rest].astype(np.uint32), count[rest].astype(np.uint16))
    if len(hot):
        named = np.unique(anchors[hot])
        out.deal(HOT, named >> np.uint64(20), named)
        met.append(_single_windows(raw, head[doc[hot]] + start[hot], ids[doc[hot]], start[hot], count[hot], out, spec))
    unit, d, s, c = _runs(*(np.concatenate(x) for x in zip(*met, strict=True)))
    if len(d):
        out.marks(*_late_windows(unit, d, s, c, head[np.searchsorted(ids, d)] + s, raw, spec))


class Steps:
    """What the tasks do, each on the rows of one bucket or a piece of the table."""

    def __init__(self, buckets: int, spec: RepeatSpec):
        self.buckets, self.spec = buckets, spec

    def find(self, ids: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        out = Out(self.buckets)
        _found(ids, texts, out, self.spec)
        return out.batch()

    def match(self, t: pa.Table) -> pa.Table:
        """Contexts by anchor: equal ones make units, windows of an anchor's different ones are sought."""
        out = Out(self.buckets)
        out.rows += [(b, x, blob) for b, x, blob in zip(*(t.column(c).to_pylist() for c in ("bucket", "kind", "blob")), strict=True) if x in (MARK, WINDOW)]
        anchors, context, doc, start, count = _read(t, ENTRY, np.uint64, np.uint64, np.int64, np.uint32, np.uint16)
        (hot,) = _read(t, HOT, np.uint64)
        start, count = start.astype(np.int64), count.astype(np.int64)
        o, new = _firsts(context, doc, start)
        out.wanted(*_units(o, new, doc, start, count, self.spec))
        first = o[new]
        _, of, contexts = np.unique(anchors[first], return_inverse=True, return_counts=True)
        sought = first[(contexts[of] > 1) | np.isin(anchors[first], hot)] if len(first) else first
        out.deal(SOUGHT, _doc_key(doc[sought]), doc[sought], start[sought].astype(np.uint32), count[sought].astype(np.uint16))
        return out.table()

    def pack(self, ids: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
        """Texts by bucket."""
        to, out = (_doc_key(ids) % np.uint64(self.buckets)).astype(np.int64), Out(self.buckets)
        order = np.argsort(to, kind="stable")
        for at in np.split(order, np.nonzero(np.diff(to[order]))[0] + 1) if len(order) else []:
            blob = _pack(ids[at], np.array([len(texts[i]) for i in at], np.int64), np.frombuffer(b"".join(texts[i] for i in at), np.uint8))
            out.rows.append((int(to[at[0]]), TEXT, blob))
        return out.batch()

    def by_id(self, t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids in order, their texts' sizes and places, and the bytes."""
        ids, size, raw = _read(t, TEXT, np.int64, np.int64, np.uint8)
        order = np.argsort(ids, kind="stable")
        return ids[order], size[order], (np.cumsum(size) - size)[order], raw

    def serve(self, texts: pa.Table, asked: pa.Table) -> pa.Table:
        """Bytes of the wanted rows go to their units; windows of the sought contexts to their fingerprints."""
        out = Out(self.buckets)
        if asked.num_rows and texts.num_rows:
            ids, _, head, raw = self.by_id(texts)
            doc, start, count = _read(asked, SOUGHT, np.int64, np.uint32, np.uint16)
            start, count = start.astype(np.int64), count.astype(np.int64)
            if len(doc):
                unit, d, s, c = _single_windows(raw, head[np.searchsorted(ids, doc)] + start, doc, start, count, out, self.spec)
                if len(d):
                    out.marks(*_late_windows(unit, d, s, c, head[np.searchsorted(ids, d)] + s, raw, self.spec))
            unit, d, s, c = _runs(*_read(asked, WANTED, np.uint64, np.int64, np.uint32, np.uint32))
            at = head[np.searchsorted(ids, d)] + s
            to = (unit % np.uint64(self.buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            for own in np.split(order, np.nonzero(np.diff(to[order]))[0] + 1) if len(order) else []:
                blob = _pack(unit[own], d[own], s[own], c[own], raw[_ranges(at[own], c[own] + self.spec.length - 1)])
                out.rows.append((int(to[own[0]]), UNIT, blob))
        return out.table()

    def pair(self, t: pa.Table) -> pa.Table:
        """Windows by fingerprint: equal ones make units."""
        out = Out(self.buckets)
        prints, doc, start = _read(t, WINDOW, np.uint64, np.int64, np.uint32)
        o, new = _firsts(prints, doc, start)
        out.wanted(*_units(o, new, doc, start.astype(np.int64), np.ones(len(doc), np.int64), self.spec))
        return out.table()

    def decide(self, t: pa.Table) -> pa.Table:
        out = Out(self.buckets)
        unit, doc, start, count, raw = _read(t, UNIT, np.uint64, np.int64, np.int64, np.int64, np.uint8)
        size = count + self.spec.length - 1
        out.marks(*_late_windows(unit, doc, start, count, np.cumsum(size) - size, raw, self.spec))
        return out.table()

    def cut(self, texts: pa.Table, marked: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
        if texts.num_rows:
            ids, size, head, raw = self.by_id(texts)
            doc, start, count = _read(marked, MARK, np.int64, np.uint32, np.uint32)
            _, doc, start, count = _runs(np.zeros(len(doc), np.uint64), doc, start, count.astype(np.int64) + self.spec.length - 1)  # now bytes
            lo, hi = np.searchsorted(doc, ids), np.searchsorted(doc, ids, side="right")
            for i in range(len(ids)):
                own = raw[head[i] : head[i] + size[i]]
                spans = [(int(a), int(a + n)) for a, n in zip(start[lo[i] : hi[i]], count[lo[i] : hi[i]], strict=True)]
                digest, at = hashlib.sha256(), 0
                for a, z in spans:
                    digest.update(own[at:a])
                    at = z
                digest.update(own[at:])
                for name, v in zip(out, (int(ids[i]), int(size[i]), sum(z - a for a, z in spans), len(spans), digest.hexdigest(), [{"start": a, "end": z} for a, z in spans]), strict=True):
                    out[name].append(v)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(out.items(), kinds, strict=True)})


def spans_removed(docs: DataFrame, spec: RepeatSpec | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of (start, end) bytes): one row per row of docs."""
    spec = spec or RepeatSpec()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shape = rows.agg(F.sum(F.octet_length("text")).alias("b"), F.count("doc_id").alias("n"), F.count(F.lit(1)).alias("all")).first()
    distinct = rows.select("doc_id").where("doc_id IS NOT NULL").distinct().count()
    named = rows.where("doc_id IS NOT NULL")
    own = named if shape["n"] == distinct else materialise(named.groupBy("doc_id").agg(F.min("text").alias("text")), "single-texts")
    buckets = max(1, -(-int(shape["b"] or 0) // spec.bucket_bytes))
    length = spec.length

    steps = Steps(buckets, spec)

    def pieces(step):
        return lambda batches: (step(ids, texts) for ids, texts in _tasks(batches, spec.map_bytes))

    # Bound methods are wrapped: the number of a function's arguments tells whether it wants the key.
    one, two = (lambda step: lambda t: step(t)), (lambda step: lambda t, u: step(t, u))
    of_kind = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    # A number of tasks that the buckets set: adaptive execution would join many small compressed buckets in one task.
    dealt = lambda df: df.repartition(min(buckets, spec.most_tasks), "bucket").groupBy("bucket")
    packed = own.mapInArrow(pieces(steps.pack), ROW)
    found = materialise(dealt(own.mapInArrow(pieces(steps.find), ROW)).applyInArrow(one(steps.match), ROW), "repeat-contexts")
    served = materialise(dealt(packed).cogroup(dealt(of_kind(found, WANTED, SOUGHT))).applyInArrow(two(steps.serve), ROW), "repeat-units")
    windows = dealt(of_kind(found, WINDOW).unionByName(of_kind(served, WINDOW))).applyInArrow(one(steps.pair), ROW)
    more = dealt(packed).cogroup(dealt(windows)).applyInArrow(two(steps.serve), ROW)
    edges = dealt(of_kind(served, UNIT).unionByName(more)).applyInArrow(one(steps.decide), ROW)
    # Not written: the texts dealt by bucket are exchanged once for this and the next step.
    marks = of_kind(found, MARK).unionByName(of_kind(served, MARK)).unionByName(edges)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    result = dealt(packed).cogroup(dealt(marks)).applyInArrow(two(steps.cut), schema)
    empty = F.expr("cast(array() as array<struct<start:long,end:long>>)")
    whole = rows.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), empty.alias("spans"))
    if shape["n"] != distinct:
        result = named.select("doc_id").join(result, "doc_id")
    return result.unionByName(whole) if shape["all"] != shape["n"] else result

"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled once into transducers, and an input is composed with them arc by arc:

* the normaliser: the model's character rules (longest match), then a machine of three states that puts a blank first,
  joins blanks where the model says so and writes them as U+2581;
* the piece trie: a path of characters emits one piece;
* byte fallback: a character of no piece emits its UTF-8 bytes, or the unknown piece;
* the weights: for unigram models one state, a piece weighs minus its score. The scores of pair-merge models order merges
  and do not add up, so there the states are pieces: a piece after another weighs 1, and infinity if the merges of the two
  side by side would not leave exactly the two.

The composition is a lattice whose states are (place, state of the weights); the tropical-semiring shortest path over it,
found place by place, is the encoding. In pair-merge models at most one path of finite weight reaches a place, the merge
result.

Pieces never continue after a blank has followed other characters (checked when compiling), and the normaliser is in the
same state behind every word, so both split into independent chunks and equal chunks are encoded once per worker.

Cases. Null text gives null ids, empty text no ids. Control pieces in a text are ordinary characters. Decoding joins
bytes, replaces invalid UTF-8 and drops the blank put first; ids out of range raise. What a model's rules change, and
U+2581 itself, which becomes a blank, decoding does not bring back; ``check`` says so. Of unigram paths of equal weight the
one whose last piece begins first is taken. Rows that repeat are encoded row by row; extra columns are kept by ``encode``
and a column of the output's name is replaced. Long texts are one row of ids.
"""

from __future__ import annotations

import hashlib
import re
import struct
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import chunks_of

BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
INF = float("inf")
NOTHING: dict = {}
assert array("i").itemsize == 4 and sys.byteorder == "little"


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of a protocol buffer message."""
    at, end = 0, len(raw)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, raw[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, raw[at : at + n]
            at += n


class Normaliser:
    """Character rules as a trie transducer (longest match, else the character itself), then blanks by states."""

    def __init__(self, charsmap: bytes, prefix: bool, squeeze: bool):
        self.prefix, self.squeeze = prefix, squeeze
        self.trie: dict = {}
        for key, out in _rules(charsmap).items():
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node[""] = out
        # Characters that begin a rule; all between them pass.
        self.first = re.compile("[" + "".join(map(re.escape, self.trie)) + "]") if self.trie else None

    def map(self, text: str) -> str:
        if self.first is None:
            return text
        out, at = [], 0
        for m in iter(lambda: self.first.search(text, at), None):
            out.append(text[at : m.start()])
            node, end, found, stop = self.trie, m.start(), text[m.start()], m.start() + 1
            while end < len(text) and (node := node.get(text[end])) is not None:
                end += 1
                if "" in node:
                    found, stop = node[""], end
            out.append(found)
            at = stop
        return "".join(out) + text[at:]

    def blanks(self, chunk: str, first: bool) -> str:
        """States: START before any character, TEXT, and GAP behind a blank that is still to be written."""
        if not first and not self.squeeze:
            return chunk.replace(" ", BLANK)  # the machine stays in TEXT
        state, out = START if first else TEXT, []
        for c in chunk:
            if c != " ":
                out.append(BLANK + c if state == GAP or (state == START and self.prefix) else c)
                state = TEXT
            elif not self.squeeze:
                out.append(BLANK + BLANK if state == START and self.prefix else BLANK)
                state = TEXT
            elif state == TEXT:
                state = GAP
        return "".join(out)


START, TEXT, GAP = range(3)


def _rules(charsmap: bytes) -> dict[str, str]:
    """Rules of a compiled character map: a double-array trie of 32-bit units, then texts that end in a zero byte. A unit
    holds its label in the low byte, whether a value follows in bit 8, and the way to its children in bits 9 to 30."""
    if not charsmap:
        return {}
    size = struct.unpack_from("<I", charsmap)[0]
    units, texts = np.frombuffer(charsmap, "<u4", size // 4, 4).tolist(), charsmap[4 + size :]
    way = lambda u: (u >> 10) << ((u & 512) >> 6)
    out, todo = {}, [(b"", way(units[0]))]
    while todo:
        key, base = todo.pop()
        for b in range(1, 256):
            at = base ^ b
            if at >= len(units) or units[at] & 0x800000FF != b:
                continue
            own = key + bytes([b])
            below = at ^ way(units[at])
            if units[at] >> 8 & 1:
                value = units[below] & 0x7FFFFFFF
                out[own] = texts[value : texts.index(b"\0", value)]
            todo.append((own, below))
    return {k.decode("utf-8"): v.decode("utf-8") for k, v in out.items()}


class PieceTransducer:
    def __init__(self, raw: bytes, cache: int = 250_000):
        self.names, self.scores, self.kinds = [], [], []
        self.model, self.byte_fallback, prefix, squeeze = UNIGRAM, False, True, True
        charsmap = b""
        for n, v in _fields(raw):
            if n == 1:
                f = dict(_fields(v))
                self.names.append(f.get(1, b"").decode("utf-8"))
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif n == 2:
                f = dict(_fields(v))
                self.model, self.byte_fallback = f.get(3, UNIGRAM), bool(f.get(35, 0))
            elif n == 3:
                f = dict(_fields(v))
                charsmap, prefix, squeeze = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        self.normaliser, self.prefix = Normaliser(charsmap, prefix, squeeze), prefix
        if self.model not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a pair-merge model")
        self.id = {s: i for i, s in enumerate(self.names) if self.kinds[i] in (NORMAL, USER)}
        if any(BLANK in s.lstrip(BLANK) for s in self.id):
            raise ValueError("a piece goes on after a blank")
        self.unknown = self.kinds.index(UNKNOWN)
        self.byte = {int(s[3:5], 16): i for i, s in enumerate(self.names) if self.kinds[i] == BYTE}
        if self.model == BPE:
            self.splits, self.times = {}, {}
            able = [s for s in self.id if self.time(s) < INF or len(s) == 1]
        else:
            able = list(self.id)
            # What a character of no piece weighs in unigram models.
            self.other = 10.0 - min((x for x, k in zip(self.scores, self.kinds, strict=True) if k == NORMAL), default=0.0)
        self.whole = dict.fromkeys(able, True)
        self.trie: tuple[dict, list] = ({}, [None])  # a node: its children by character, and the piece that ends there
        for s in able:
            node = self.trie
            for c in s:
                node = node[0].setdefault(c, ({}, [None]))
            node[1][0] = s
        self.trie = self._frozen(self.trie)
        self.out = [
            bytes([int(s[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else s.replace(BLANK, " ").encode()
            for s, k in zip(self.names, self.kinds, strict=True)
        ]
        self.out_len = np.array(list(map(len, self.out)), np.int64)
        self.out_at = np.concatenate([[0], np.cumsum(self.out_len)[:-1]])
        self.out_all = np.frombuffer(b"".join(self.out), np.uint8)
        self.fits: dict[str, dict[str, bool]] = {}  # by the piece on the left, then the one on the right
        self.n_fits = 0
        self.young: dict[str, bytes] = {}  # chunks met lately, and those of the generation before
        self.old: dict[str, bytes] = {}
        self.cache_size = cache

    # -- pair-merge models: which pieces may stand side by side

    def rank(self, s: str) -> float:
        i = self.id.get(s)
        return INF if i is None else -self.scores[i]

    def split(self, s: str) -> tuple[str, str] | None:
        """The last merge that makes piece s, None for a character."""
        if len(s) == 1:
            return None
        if s not in self.splits:
            own: dict[str, tuple[str, str]] = {}
            symbols = list(s)
            while len(symbols) > 1:
                r, at = min((self.rank(symbols[i] + symbols[i + 1]), i) for i in range(len(symbols) - 1))
                if r == INF:
                    break
                own[symbols[at] + symbols[at + 1]] = (symbols[at], symbols[at + 1])
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            self.splits[s] = own[s] if symbols == [s] else ("", "")  # merges never make it
        return self.splits[s]

    def time(self, s: str) -> float:
        """When piece s comes about: its own rank or that of a later part."""
        t = self.times.get(s)
        if t is None:
            parts = self.split(s)
            t = -INF if parts is None else INF if parts[0] == "" else max(self.rank(s), self.time(parts[0]), self.time(parts[1]))
            self.times[s] = t
        return t

    def fit(self, u: str, v: str) -> bool:
        """Whether merging the characters of u + v ends with u, v.

        Goes back in time along the right edge of u and the left edge of v: while both parts stand side by side, their
        own merge must not come before the next merge of either.
        """
        known = self.fits.get(u, {}).get(v)
        if known is not None:
            return known
        self.n_fits += 1
        if self.n_fits > 250_000:
            self.fits.clear()
            self.n_fits = 1
        r, left, until, boundary_first, ok = u, v, INF, False, True
        while True:
            c = self.rank(r + left)
            if c < INF:
                c = max(c, self.time(r), self.time(left))
                if c < until or (c == until and boundary_first):
                    ok = False
                    break
            if len(r) == 1 and len(left) == 1:
                break
            tr, tl = self.time(r), self.time(left)
            if len(left) > 1 and (tl >= tr or len(r) == 1):
                until, boundary_first, left = tl, True, self.split(left)[0]
            else:
                until, boundary_first, r = tr, False, self.split(r)[1]
        self.fits.setdefault(u, {})[v] = ok
        return ok

    @staticmethod
    def _frozen(node: tuple[dict, list]) -> tuple[dict, str | None]:
        return {c: PieceTransducer._frozen(n) for c, n in node[0].items()}, node[1][0]

    # -- composition and shortest path

    def arcs(self, chunk: str, place: int) -> list[str]:
        """Pieces that begin at a place, shortest first; a character of no piece stands for its fallback."""
        node, end, found = self.trie, place, []
        while end < len(chunk) and (node := node[0].get(chunk[end])) is not None:
            end += 1
            if node[1] is not None:
                found.append(node[1])
        if not found or len(found[0]) > 1:
            found.insert(0, chunk[place])
        return found

    def weight(self, state: str | None, piece: str) -> float:
        """Weight of a piece after a state."""
        i = self.id.get(piece)
        if self.model == UNIGRAM:
            return self.other if i is None else -self.scores[i]
        if i is None or not state or state not in self.id:
            return 1.0  # a character of no piece never merges
        return 1.0 if self.fit(state, piece) else INF

    def shortest(self, chunk: str) -> list[str]:
        """Pieces of the shortest path over the lattice, place by place. One state of the weights is kept for each place:
        unigram models have one, and in pair-merge models all but one have infinite weight. ``arcs`` and ``weight`` stand
        inline, as this is the inner loop."""
        n, merges, root, ids, fits, scores = len(chunk), self.model == BPE, self.trie, self.id, self.fits, self.scores
        if merges and self.whole.get(chunk):
            return [chunk]  # one arc, and no path is shorter
        cost, last = [0.0] + [INF] * n, [""] * (n + 1)
        for place in range(n):
            so_far, state = cost[place], last[place]
            if so_far == INF:
                continue
            bound, children, end = merges and state in ids, root[0], place
            fitting = fits.get(state, NOTHING) if bound else NOTHING
            while end < n and (node := children.get(chunk[end])) is not None:
                end += 1
                children, piece = node
                if piece is None:
                    continue
                if merges:
                    if cost[end] < INF:
                        continue
                    if bound:
                        ok = fitting.get(piece)
                        if not (self.fit(state, piece) if ok is None else ok):
                            continue
                    w = so_far + 1.0
                else:
                    w = so_far - scores[ids[piece]]
                if w < cost[end]:
                    cost[end], last[end] = w, piece
            if chunk[place] not in ids and so_far + (1.0 if merges else self.other) < cost[place + 1]:
                cost[place + 1], last[place + 1] = so_far + (1.0 if merges else self.other), chunk[place]
        out = []
        while n:
            out.append(last[n])
            n -= len(last[n])
        return out[::-1]

    def path(self, chunk: str) -> list[int]:
        """Ids of the shortest path over the lattice of one normalised chunk."""
        out = []
        for s in self.shortest(chunk) if chunk else ():
            i = self.id.get(s)
            if i is not None:
                out.append(i)
            elif self.byte_fallback and self.byte:
                out.extend(self.byte[b] for b in s.encode("utf-8"))
            else:
                out.append(self.unknown)
        return out

    def _ids(self, chunk: str, first: bool = False) -> bytes:
        return array("i", self.path(self.normaliser.blanks(chunk, first))).tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers. A chunk is a run of blanks and what follows up to the next; the first one
        differs only by the state the normaliser is in."""
        text = self.normaliser.map(text)
        if self.normaliser.prefix and self.normaliser.squeeze:
            chunks, head = _CHUNK.findall(" " + text.lstrip(" ")), b""  # the same as the blank put first
            if not text.strip(" "):
                return b""
        else:
            chunks = _CHUNK.findall(text)
            head = self._ids(chunks[0], True) if chunks else b""
            del chunks[:1]
        out = list(map(self.young.get, chunks))
        if None in out:
            young, old = self.young, self.old
            for at, got in enumerate(out):
                if got is None:
                    c = chunks[at]
                    got = young.get(c)
                    if got is None:
                        got = old.get(c)
                    if got is None:
                        got = self._ids(c)
                    if len(c) < 200:
                        if len(young) >= self.cache_size:
                            self.old = old = young
                            self.young = young = {}
                        young[c] = got
                    out[at] = got
        return head + b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i4").tolist()

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.out)):
            raise ValueError("id out of range")
        sizes = self.out_len[ids]
        total = int(sizes.sum())
        ends = np.cumsum(sizes)
        at = np.arange(total) - np.repeat(ends - sizes, sizes) + np.repeat(self.out_at[ids], sizes)
        text = self.out_all[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


_CHUNK = re.compile(f"[ {BLANK}]*[^ {BLANK}]+|[ {BLANK}]+")
_COMPILED: dict[str, PieceTransducer] = {}


def compiled(raw: bytes) -> PieceTransducer:
    key = hashlib.sha256(raw).hexdigest()
    if key not in _COMPILED:
        _COMPILED[key] = PieceTransducer(raw)
    return _COMPILED[key]


def _broadcast(spark: SparkSession, model_path: str):
    """The model file, a constant of well under a MB whatever the corpus, read by the driver for all executors."""
    with open(model_path, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError("model file over 64 MB")
    return spark.sparkContext.broadcast(raw)


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", check: str | None = None) -> DataFrame:
    """docs with an array of piece ids; check: name of a boolean column, whether decoding gives the text back. Whole texts
    go to Python: a job over long ones wants few rows in an Arrow batch (spark.sql.execution.arrow.maxRecordsPerBatch)."""
    model = _broadcast(docs.sparkSession, model_path)
    keep = [c for c in docs.columns if c not in (ids, check)]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(ids, T.ArrayType(T.IntegerType()))] + ([T.StructField(check, T.BooleanType())] if check else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model.value)
        for batch in chunks_of(batches, text, 1_000_000):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            raws = [None if x is None else t.encode_bytes(x) for x in texts]
            ends = np.cumsum([0] + [0 if r is None else len(r) // 4 for r in raws], dtype=np.int32)
            flat = np.frombuffer(b"".join(r for r in raws if r), "<i4")
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.array([r is None for r in raws] + [False])), pa.array(flat, pa.int32()))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [lists]
            if check:
                cols.append(pa.array([None if r is None else t.decode(np.frombuffer(r, "<i4")) == x for r, x in zip(raws, texts, strict=True)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the text of its ids (null for null ids)."""
    model = _broadcast(encoded.sparkSession, model_path)
    keep = [c for c in encoded.columns if c != text]
    schema = T.StructType([encoded.schema[c] for c in keep] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = compiled(model.value)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(ids))
            got = [t.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else None for x in col]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(got, pa.string())], names=schema.names)

    return encoded.select(*[f"`{c}`" for c in keep]).mapInArrow(run, schema)

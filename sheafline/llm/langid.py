"""Language of texts by a linear-chain conditional random field over words.

Words are runs of letters; a word's features are its first and last one to three bytes, its byte trigrams with word ends,
and the word itself if the training sample knew it (lexicon). Labels are languages, transitions are learned, and
forward-backward gives each word's posterior, so code-switched texts are labelled word by word. A text's language is the
one with the largest posterior mass over its words, its score that mass per word.

Training uses a bounded sample: about ``train_docs`` whole texts, dealt evenly over languages by a hash of the id. They are
cut into runs of ``window`` words, all of which are used in every epoch, and runs are joined in random order across
languages so that switches are seen. The driver maximises the regularised likelihood by Adagrad; expected transitions are
the pair marginals of forward-backward. Weights are hashed into 2^bits rows, so the model's size is fixed.

Cases. Null texts and texts without a letter are ``und`` with score 0, as are all where no row is labelled. Of languages
with equal posterior mass the first by name is taken. Very long texts are labelled whole. Repeated rows are labelled one by
one; extra columns are dropped unless named in keep, and columns named lang_pred or score are replaced. Null languages
never train.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks_of, hash_sample

LETTER = re.compile(r"[^\W\d_]")
UNDETERMINED = "und"


@dataclass(frozen=True)
class CrfSpec:
    train_docs: int = 400
    window: int = 24
    epochs: int = 3
    batch: int = 100
    rate: float = 0.3
    l2: float = 1e-6
    bits: int = 17
    seed: int = 5


# Bytes that belong to words: letters of ASCII and everything beyond it.
_WORD = np.zeros(256, bool)
_WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slot(code: np.ndarray, salt: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (code.astype(np.uint64) + np.uint64(salt * 0x51ED27)) * _MIX
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


@dataclass
class Words:
    """Words of joined texts: counts per text; per word its nine feature slots (-1: none) and the span of its trigrams."""

    per_text: np.ndarray
    affix: np.ndarray
    first: np.ndarray
    tri: np.ndarray


def featurise(texts: list[bytes], bits: int) -> Words:
    """texts: lower-cased UTF-8. All by array operations over the joined bytes."""
    raw = np.frombuffer(b"    " + b"    ".join(texts) + b"    ", np.uint8)
    inside = _WORD[raw]
    edge = np.diff(inside.astype(np.int8))
    first, end = np.nonzero(edge == 1)[0] + 1, np.nonzero(edge == -1)[0] + 1
    begins = np.cumsum([4] + [len(t) + 4 for t in texts])
    per_text = np.diff(np.searchsorted(first, begins))
    b = np.where(inside, raw, 32).astype(np.int64)
    size = end - first
    cols = []
    for n in (1, 2, 3):
        head = sum(b[first + i] << (8 * i) for i in range(n))
        tail = sum(b[end - 1 - i] << (8 * i) for i in range(n))
        for salt, code in ((n, head), (n + 8, tail)):
            cols.append(np.where(size >= n, _slot(code, salt, bits), -1))
    at = np.nonzero(inside)[0]
    tri = _slot(b[at - 1] | (b[at] << 8) | (b[at + 1] << 16), 20, bits)
    # Whole words by a hash of all bytes: powers of an odd number, taken back to the word's start.
    with np.errstate(over="ignore"):
        local = (np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)).astype(np.uint64)
        term = (b[at].astype(np.uint64) + np.uint64(7)) * _power(local)
        whole = np.add.reduceat(term, np.cumsum(size) - size) if len(size) else np.zeros(0, np.uint64)
    cols.append(_slot(whole, 30, bits))
    return Words(per_text, np.stack(cols, 1) if len(first) else np.zeros((0, 7), np.int64), np.cumsum(size) - size, tri)


def _power(n: np.ndarray) -> np.ndarray:
    """A pseudo-random odd factor for each place in a word."""
    with np.errstate(over="ignore"):
        x = (n + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x | np.uint64(1)


@dataclass
class Crf:
    labels: list[str]
    weights: np.ndarray  # 2^bits + 1 rows; the last is for absent features
    known: np.ndarray  # which slots the sample's words took
    move: np.ndarray
    start: np.ndarray
    bits: int

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.affix):
            return np.zeros((0, len(self.labels)), np.float32)
        out = np.add.reduceat(self.weights[w.tri], w.first, axis=0)
        for i in range(w.affix.shape[1]):
            slot = w.affix[:, i]
            if i == w.affix.shape[1] - 1:
                slot = np.where(self.known[slot], slot, -1)
            out += self.weights[slot]
        return out

    def posteriors(self, e: np.ndarray, per_text: np.ndarray, pairs: np.ndarray | None = None) -> np.ndarray:
        """Posterior of each label for each word; texts side by side, longest first. The posteriors of pairs of labels of
        neighbouring words are added to pairs."""
        n = len(per_text)
        off = np.cumsum(per_text) - per_text
        order = np.argsort(-per_text, kind="stable")
        off, size = off[order], per_text[order]
        p = np.exp(e - e.max(axis=1, keepdims=True)) if len(e) else e
        move, start = np.exp(self.move - self.move.max()), np.exp(self.start - self.start.max())
        fwd = np.empty_like(p)
        active = np.searchsorted(-size, -np.arange(1, (size[0] if n else 0) + 1), side="right")
        a = None
        for t, m in enumerate(active):
            at = off[:m] + t
            a = p[at] * (start if t == 0 else a[:m] @ move)
            a /= a.sum(axis=1, keepdims=True)
            fwd[at] = a
        back = np.ones((n, len(self.labels)), p.dtype)
        post = fwd
        for t in range(len(active) - 1, -1, -1):
            m = active[t]
            at = off[:m] + t
            g = fwd[at] * back[:m]
            post[at] = g / g.sum(axis=1, keepdims=True)
            ahead = p[at] * back[:m]
            if t and pairs is not None:
                joint = fwd[at - 1][:, :, None] * move * ahead[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            x = ahead @ move.T
            back[:m] = x / x.sum(axis=1, keepdims=True)
        return post


def train_rows(labelled: DataFrame, spec: CrfSpec) -> DataFrame:
    """The bounded sample: lang, text of about train_docs rows, shared evenly by the languages (doc_id is the hash key)."""
    x = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", "text")
    langs = max(1, x.select("lang").distinct().count())
    return hash_sample(x, -(-spec.train_docs // langs), by="lang").select("lang", "text")


def train(labelled: DataFrame, spec: CrfSpec | None = None) -> Crf | None:
    """labelled: rows with doc_id, text and lang."""
    spec = spec or CrfSpec()
    rows = [(r["lang"], r["text"]) for r in train_rows(labelled, spec).collect()]  # bounded by train_docs
    labels = sorted({lang for lang, _ in rows})
    if not labels:
        return None
    rng = np.random.default_rng(spec.seed)
    runs: list[tuple[int, list[str]]] = []
    for lang, text in sorted(rows):
        words = re.findall(r"[^\W\d_]+", text.lower())
        runs += [(labels.index(lang), words[a : a + spec.window]) for a in range(0, len(words), spec.window)]
    if not runs:
        return None
    n, k = 1 << spec.bits, len(labels)
    crf = Crf(labels, np.zeros((n + 1, k), np.float32), np.zeros(n, bool), np.zeros((k, k)), np.zeros(k), spec.bits)
    seen, seen_move, seen_start = np.full((n + 1, k), 1e-6, np.float32), np.full((k, k), 1e-6), np.full(k, 1e-6)
    for epoch in range(spec.epochs):
        order = [runs[i] for i in rng.permutation(len(runs))]
        ends = np.cumsum(rng.integers(1, 4, len(order)))  # one to three runs make a sequence
        ends = [0, *ends[ends < len(order)].tolist(), len(order)]
        sequences = [order[a:z] for a, z in zip(ends, ends[1:], strict=False)]
        for a in range(0, len(sequences), spec.batch):
            batch = sequences[a : a + spec.batch]
            w = featurise([" ".join(" ".join(p) for _, p in s).encode() for s in batch], spec.bits)
            gold = np.concatenate([np.repeat([y for y, _ in s], [_count(p) for _, p in s]) for s in batch]).astype(np.int64)
            if len(gold) != len(w.affix) or not len(gold):
                continue
            if not epoch:
                crf.known[w.affix[:, -1]] = True
            expected = np.zeros((k, k))
            delta = -crf.posteriors(crf.emissions(w).astype(np.float64), w.per_text, expected)
            soft = -delta
            delta[np.arange(len(gold)), gold] += 1
            g = np.zeros_like(crf.weights)
            sizes = np.diff(np.append(w.first, len(w.tri)))
            np.add.at(g, w.tri, np.repeat(delta, sizes, axis=0).astype(np.float32))
            for i in range(w.affix.shape[1]):
                np.add.at(g, w.affix[:, i], delta.astype(np.float32))
            g[-1] = 0
            hit = np.nonzero(g.any(axis=1))[0]
            gh = g[hit] / len(batch) - spec.l2 * crf.weights[hit]
            seen[hit] += gh**2
            crf.weights[hit] += spec.rate * gh / np.sqrt(seen[hit])
            # Transitions: observed pairs less the expected ones.
            ends = np.cumsum(w.per_text)
            at = np.setdiff1d(np.arange(1, len(gold)), ends)
            gm = np.zeros((k, k))
            np.add.at(gm, (gold[at - 1], gold[at]), 1)
            gm = (gm - expected) / len(batch) - 1e-3 * crf.move
            seen_move += gm**2
            crf.move += spec.rate * gm / np.sqrt(seen_move)
            heads = (ends - w.per_text)[w.per_text > 0]
            gs = (np.eye(k)[gold[heads]] - soft[heads]).sum(axis=0) / len(batch) - 1e-3 * crf.start
            seen_start += gs**2
            crf.start += spec.rate * gs / np.sqrt(seen_start)
    crf.weights[-1] = 0
    return crf


def _count(words: list[str]) -> int:
    """Words the featuriser sees in these (a mark on a letter of ASCII stays one run of bytes)."""
    raw = np.frombuffer(b" " + " ".join(words).encode() + b" ", np.uint8)
    return int((np.diff(_WORD[raw].astype(np.int8)) == 1).sum())


def label_texts(crf: Crf, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    whole = [b"" if t is None else t.lower().encode("utf-8", "replace") for t in texts]
    parts, a, total = [], 0, 0
    for i, t in enumerate(whole):  # features of about 1 MB at a time
        total += len(t) + 4
        if total > 1_000_000:
            parts.append((a, i + 1))
            a, total = i + 1, 0
    parts.append((a, len(whole)))
    es, counts = [], []
    for a, z in parts:
        if z > a:
            w = featurise(whole[a:z], crf.bits)
            es.append(crf.emissions(w))
            counts.append(w.per_text)
    per_text = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    e = np.concatenate(es) if es else np.zeros((0, len(crf.labels)), np.float32)
    post = crf.posteriors(e, per_text)
    mass = np.zeros((len(texts), len(crf.labels)))
    full = np.nonzero(per_text)[0]
    if len(full):
        mass[full] = np.add.reduceat(post, (np.cumsum(per_text) - per_text)[full], axis=0)
    best = mass.argmax(axis=1) if len(texts) else np.zeros(0, int)
    score = mass[np.arange(len(texts)), best] / np.maximum(per_text, 1)
    names = []
    for i, t in enumerate(texts):
        if t is None or not per_text[i] or not LETTER.search(t):
            names.append(UNDETERMINED)
            score[i] = 0.0
        else:
            names.append(crf.labels[int(best[i])])
    return names, np.clip(np.nan_to_num(score), 0.0, 1.0)


def predict(docs: DataFrame, crf: Crf | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, lang_pred, score for each row of docs; the model is broadcast, its size fixed by the hash."""
    if crf is None:
        return docs.select(*keep, F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(crf)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks_of(batches, "text", 4_000_000):
            names, score = label_texts(model.value, batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in keep], pa.array(names, pa.string()), pa.array(score, pa.float64())], names=schema.names)

    return docs.select(*keep, "text").mapInArrow(run, schema)


def fold(doc_id: Column, n: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(0))

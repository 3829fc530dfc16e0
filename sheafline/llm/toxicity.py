"""Toxicity of texts: a lexicon with misspellings, weighed by what stands around each hit.

1. Lexicon. Words and word heads (4 to 7 letters) are counted by label over all different labelled texts, and strong words
   by how many different words stand before them: a word of one text that is copied with small changes has many texts but
   one neighbour, and stays out before terms are ranked. Terms weigh their log ratio. Heads enter if several strong words
   begin with them.
2. Spelling. The lexicon is a trie. Levenshtein automata of its terms run over the trie together: a state is a set of
   (trie node, edits left), made when first met and kept. A word is fed letter by letter and most words reach the dead
   state after two or three. Terms of 5 letters may differ by one edit, of 9 by two; shorter ones by none. A head
   matches any word that begins with it, a whole term only whole words.
3. Context. Every hit gets a window of words around it: quotation marks around the hit and words of report make it a
   quotation, exclamation marks, capitals and other hits make it abuse.
4. Score. A logistic regression over the weights of hits by kind and context and the text's capitals and exclamation
   marks, fitted on a bounded sample by iterated reweighted least squares.

Cases. Null and empty texts get the score of a text without hits. A score of exactly 0.5 counts as toxic where a decision
is made. Unlabelled rows, null labels and labels other than 0
and 1 never train; without both labels every score is 0. Whole texts are read, however long. Repeated rows are scored
one by one; extra columns are dropped unless named in keep.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks_of, discard, hash_sample, materialise
from .exact_dedup import text_digest


@dataclass(frozen=True)
class ToxSpec:
    """fit_docs: about how many texts of each label the driver collects. min_hits, min_share, min_before, min_ratio: toxic
    texts, share of them, words before and ratio that a word must reach; as a text holds so many words, a least share bounds
    the lexicon whatever the number of texts. head_words: strong words that make a head. most_states: automaton states and
    moves kept by a worker."""

    fit_docs: int = 3000
    min_share: float = 0.0002
    min_hits: int = 5
    min_before: int = 4
    min_ratio: float = 8.0
    head_ratio: float = 3.0
    head_words: int = 5
    window: int = 6
    l2: float = 0.05
    most_states: int = 200_000


WORD = re.compile(r"\w[\w@$*]*")
# Marks that open and close quotations, and English words of report.
QUOTES = "\"“”„«»‘’"
REPORT = frozenset("said says wrote called quote quoted reported term word phrase slur label".split())
FEATURES = ("whole", "near", "head", "quoted", "abuse", "kinds", "share", "capitals", "shouts")


class Lexicon:
    """Terms (text, whether a head, weight) as a trie with Levenshtein automata run over it."""

    def __init__(self, terms: list[tuple[str, bool, float]], most_states: int = 200_000):
        self.terms = sorted({(t, h): w for t, h, w in terms}.items())
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, bool, int]]] = [[]]  # per node: (allowed edits, head, number of the term)
        self.depth_allow: list[int] = [0]  # most edits any term below a node allows
        self.weights = [w for _, w in self.terms]
        self.is_head = [h for (_, h), _ in self.terms]
        for number, ((term, head), _) in enumerate(self.terms):
            allow = 0 if head or len(term) < 5 else 1 if len(term) < 9 else 2
            node = 0
            self.depth_allow[0] = max(self.depth_allow[0], allow)
            for c in term:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][c] = nxt
                    self.children.append({})
                    self.ends.append([])
                    self.depth_allow.append(0)
                node = nxt
                self.depth_allow[node] = max(self.depth_allow[node], allow)
            self.ends[node].append((allow, head, number))
        self.alphabet = {c for (t, _), _ in self.terms for c in t}
        self.most_states = most_states
        self._clear()

    def _clear(self) -> None:
        """Forget all states; they are made again when met."""
        self.n_moves = 0
        self.states: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple, int] = {}
        self.moves: list[dict[str, int]] = []
        self.accept: list[tuple[int, int] | None] = []  # (edits, term) of the best whole-word match at a state
        self.heads: list[tuple[int, int] | None] = []  # and of the best head met there
        self.start = self._state({0: 0})

    def _state(self, best: dict[int, int]) -> int:
        """State of the nodes with their least edits, with skipped letters of terms followed."""
        todo = list(best.items())
        while todo:
            node, used = todo.pop()
            if used > best.get(node, 9):
                continue
            for nxt in self.children[node].values():
                if used + 1 <= self.depth_allow[nxt] and used + 1 < best.get(nxt, 9):
                    best[nxt] = used + 1
                    todo.append((nxt, used + 1))
        key = tuple(sorted(best.items()))
        known = self.number.get(key)
        if known is None:
            known = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            best_of = lambda heads: min(((u, -self.weights[k], k) for n, u in key for allow, h, k in self.ends[n] if h == heads and u <= allow), default=None)
            for kind, out in ((False, self.accept), (True, self.heads)):
                found = best_of(kind)
                out.append(found and (found[0], found[2]))
        return known

    def _move(self, state: int, c: str) -> int:
        best: dict[int, int] = {}
        for node, used in self.states[state]:
            for letter, nxt in self.children[node].items():
                cost = used + (letter != c)
                if cost <= self.depth_allow[nxt] and cost < best.get(nxt, 9):
                    best[nxt] = cost
            if used + 1 <= self.depth_allow[node] and used + 1 < best.get(node, 9):
                best[node] = used + 1  # a letter too many
        out = self._state(best) if best else -1
        self.moves[state][c] = out
        self.n_moves += 1
        return out

    def match(self, word: str) -> tuple[int, int] | None:
        """(edits, number of the term) of the best match: a whole term before a head, fewer edits first."""
        if len(self.states) + self.n_moves > self.most_states:
            self._clear()
        state, front, moves, heads = self.start, None, self.moves, self.heads
        for c in word:
            if c not in self.alphabet:
                c = ""  # all other letters behave alike
            nxt = moves[state].get(c)
            if nxt is None:
                nxt = self._move(state, c)
            if nxt < 0:
                return front
            state = nxt
            if heads[state] is not None:
                front = heads[state]
        whole = self.accept[state]
        return front if whole is None or (front is not None and whole[0]) else whole


@dataclass
class ToxModel:
    terms: list[tuple[str, bool, float]]
    weights: list[float] = field(default_factory=list)  # intercept first
    centre: list[float] = field(default_factory=list)
    scale: list[float] = field(default_factory=list)
    window: int = 6


def features(lexicon: Lexicon, text: str | None, window: int = 6, memo: dict | None = None) -> list[float]:
    t = text or ""
    low = WORD.findall(t.lower())
    shouts = math.log1p(t.count("!"))
    if not low:
        return [0.0] * (len(FEATURES) - 1) + [shouts]
    match, alphabet = lexicon.match, lexicon.alphabet
    memo = {} if memo is None else memo
    hits = []
    for i, w in enumerate(low):
        c = w[0]
        if lexicon.moves[0].get(c if c in alphabet else "", 0) < 0:
            continue  # dead after the first letter
        if w in memo:
            d = memo[w]
        else:
            if len(memo) > 80_000:
                memo.clear()
            d = memo[w] = match(w)
        if d is not None:
            hits.append((i, *d))
    words = WORD.findall(t)
    capitals = sum(w.isupper() and len(w) > 1 for w in words) / len(words)
    out = [0.0] * 5
    if hits:
        if len(words) != len(low):  # lower-casing changed the words
            t = t.lower()
        spans = [m.span() for m in WORD.finditer(t)]
        at = {i for i, _, _ in hits}
        for i, d, k in hits:
            a, z = max(0, i - window), min(len(spans), i + window + 1)
            left, right = t[spans[a][0] : spans[i][0]], t[spans[i][1] : spans[z - 1][1] + 1]
            quoted = any(q in left and q in right for q in QUOTES) or any(o in left and c in right for o, c in ("“”", "„“", "«»", "‘’"))
            quoted = quoted or bool(REPORT & set(low[max(0, i - 3) : i]))
            heat = min(1.0, 0.5 * ("!" in right) + 0.5 * t[slice(*spans[i])].isupper() + 0.25 * sum(j in at for j in range(a, z) if j != i))
            weight = lexicon.weights[k]
            if quoted:
                out[3] += weight
            else:
                out[2 if lexicon.is_head[k] else 0 if d == 0 else 1] += weight
                out[4] += heat * weight
    total = sum(out[:4])
    return [*map(math.log1p, out), math.log1p(len({k for _, _, k in hits})), math.log1p(100.0 * total / len(low)), capitals, shouts]


LETTERS = r"[\p{L}\p{N}]+"


def _words(labelled: DataFrame) -> DataFrame:
    share = [F.col("share")] if "share" in labelled.columns else []
    return labelled.select("toxic", *share, F.regexp_extract_all(F.lower("text"), F.lit(LETTERS), F.lit(0)).alias("ws"))


def shared(labelled: DataFrame, digests: DataFrame) -> DataFrame:
    """labelled with share, 1 over the number of rows with that label and text, so that copies add up to one text."""
    repeated = digests.where("n > 1")
    # Up to so many (about 80 bytes each) are sent to the texts; more are joined by an exchange of both.
    if repeated.count() <= 1_000_000:
        repeated = F.broadcast(repeated)
    joined = labelled.withColumn("digest", text_digest(F.col("text"))).join(repeated, ["toxic", "digest"], "left")
    return joined.select("toxic", "text", (F.lit(1.0) / F.coalesce(F.col("n"), F.lit(1))).alias("share"))


def term_counts(texts: DataFrame) -> DataFrame:
    """(word, pos, neg): different labelled texts by word. Texts stay where they are; words are counted before they are dealt."""
    words = _words(texts).select("toxic", "share", F.explode(F.array_distinct("ws")).alias("word")).where(F.length("word") >= 3)
    of = lambda k: F.round(F.sum(F.when(F.col("toxic") == k, F.col("share")).otherwise(F.lit(0.0)))).cast("long")
    return words.groupBy("word").agg(of(1).alias("pos"), of(0).alias("neg"))


def words_before(labelled: DataFrame, strong: DataFrame) -> DataFrame:
    """(word, n): how many different words stand before each of the words of strong in toxic texts."""
    ws = F.col("ws")
    previous = F.concat(F.array(F.lit("")), F.slice(ws, F.lit(1), F.greatest(F.size(ws) - 1, F.lit(0))))
    pairs = _words(labelled.where("toxic = 1")).select(F.explode(F.zip_with(ws, previous, lambda w, p: F.struct(w.alias("word"), p.alias("p")))).alias("x")).select("x.*")
    named = strong.select("word")
    # So many words are sent to the texts; more meet their pairs in an exchange.
    if named.count() <= 200_000:
        return pairs.join(F.broadcast(named), "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return pairs.distinct().join(named, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _sample(labelled: DataFrame, most: int) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {0: [], 1: []}
    for r in hash_sample(labelled, most, by="toxic").orderBy(F.xxhash64("doc_id")).select("toxic", "text").collect():
        out[r["toxic"]].append(r["text"] or "")
    return out


def learn(labelled: DataFrame, spec: ToxSpec | None = None) -> ToxModel:
    """labelled: doc_id, text, toxic (0 or 1)."""
    spec = spec or ToxSpec()
    labelled = labelled.where("toxic IN (0, 1)").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    digests = materialise(labelled.groupBy("toxic", text_digest(F.col("text")).alias("digest")).agg(F.count(F.lit(1)).alias("n")), "label-digests")
    sizes = {r["toxic"]: r for r in digests.groupBy("toxic").agg(F.count(F.lit(1)).alias("texts")).collect()}
    if 0 not in sizes or 1 not in sizes:
        return ToxModel([], [-50.0] + [0.0] * len(FEATURES), [0.0] * len(FEATURES), [1.0] * len(FEATURES), spec.window)
    counts = materialise(term_counts(shared(labelled, digests)), "word-counts")
    ratio = (F.col("pos") + 0.1) / sizes[1]["texts"] / ((F.col("neg") + 0.5) / sizes[0]["texts"])
    counts = counts.withColumn("w", F.log(ratio))
    least = max(spec.min_hits, spec.min_share * sizes[1]["texts"])
    strong = counts.where((F.col("pos") >= least) & (ratio >= spec.min_ratio))
    apart = words_before(labelled, strong).where(F.col("n") >= spec.min_before).select("word")
    rows = strong.join(apart, "word").collect()  # bounded by min_share
    rows.sort(key=lambda r: (-r["pos"] * r["w"], r["word"]))
    terms = [(r["word"], False, min(5.0, r["w"])) for r in rows]
    members: dict[str, int] = {}
    for term, _, _ in terms:
        for k in range(4, min(8, len(term))):
            members[term[:k]] = members.get(term[:k], 0) + 1
    members = {h: m for h, m in members.items() if m >= spec.head_words}
    found = []
    if members:
        named = labelled.sparkSession.createDataFrame([(h,) for h in members], "head string")
        heads = counts.select(F.explode(F.transform(F.sequence(F.lit(4), F.lit(7)), lambda k: F.when(F.length("word") > k, F.substring(F.col("word"), F.lit(1), k)))).alias("head"), "pos", "neg")
        heads = heads.join(F.broadcast(named), "head").groupBy("head").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        found = [(r["head"], r["pos"], r["w"]) for r in heads.withColumn("w", F.log(ratio)).where(ratio >= spec.head_ratio).collect()]
        found.sort(key=lambda x: (-x[1] * x[2], x[0]))
    longer = lambda h, p: any(o != h and o.startswith(h) and q >= 0.9 * p for o, q, _ in found)
    terms += [(h, True, min(5.0, w)) for h, p, w in found if not longer(h, p)]
    discard(digests, counts)
    sample = _sample(labelled, spec.fit_docs)
    pos, neg = sample[1], sample[0]
    lexicon = Lexicon(terms, spec.most_states)
    memo: dict = {}
    x = np.array([features(lexicon, t, spec.window, memo) for t in pos + neg])
    y = np.array([1.0] * len(pos) + [0.0] * len(neg))
    # Each label's rows stand for all texts of that label, copies for one.
    times = Counter(zip(y.tolist(), pos + neg, strict=True))
    own = np.array([1 / times[k] for k in zip(y.tolist(), pos + neg, strict=True)])
    w = own * np.where(y == 1, sizes[1]["texts"] / max(1, own @ y), sizes[0]["texts"] / max(1, own @ (1 - y)))
    return ToxModel(terms, *_regress(x, y, w / w.mean(), spec.l2), spec.window)


def _regress(x: np.ndarray, y: np.ndarray, w: np.ndarray, l2: float) -> tuple[list[float], list[float], list[float]]:
    centre, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    b, ridge = np.zeros(z.shape[1]), np.diag([1e-6] + [l2] * x.shape[1]) * len(x) / 100
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        h = (z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + ridge
        step = np.linalg.solve(h, z.T @ (w * (y - p)) - ridge @ b)
        b += step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return b.tolist(), centre.tolist(), scale.tolist()


class Scorer:
    def __init__(self, model: ToxModel):
        self.model, self.lexicon, self.memo = model, Lexicon(model.terms), {}
        self.w, self.c, self.s = map(np.array, (model.weights, model.centre, model.scale))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([features(self.lexicon, t, self.model.window, self.memo) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.w[0] + (x - self.c) / self.s @ self.w[1:], -50, 50)))


def score(docs: DataFrame, model: ToxModel, keep: tuple[str, ...] | None = None, column: str = "score") -> DataFrame:
    """keep (None: all columns but one named column, which is replaced) and the score of each row of docs. Whole texts go to
    Python: a job over long ones wants few rows in an Arrow batch (spark.sql.execution.arrow.maxRecordsPerBatch)."""
    names = [c for c in (docs.columns if keep is None else keep) if c != column]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField(column, T.DoubleType())])
    own = docs.select(*[F.col(f"`{c}`") for c in names], *([] if "text" in names else ["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in chunks_of(batches, "text", 2_000_000):
            got = scorer(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in names], pa.array(got, pa.float64())], names=schema.names)

    return own.mapInArrow(run, schema)

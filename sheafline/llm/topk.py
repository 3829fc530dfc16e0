"""Exact top-k inner products by the three-phase uniform threshold algorithm.

The dimensions of the integer vectors are dealt to ``slices`` nodes; a pair's score is the sum of one partial product per
node. Vectors are packed in blocks, and every (query block, candidate block, node) is one cell of work, so memory per task
is fixed and cells spread over any number of machines. Candidate blocks stay where they are dealt; the blocks of the
stated query set, far fewer, are copied to them.

1. Each node sends, for each query, the k best partial products of its slice. The exact scores of the candidates so
   gathered give the cutoff T of the query: the k-th best of them, a lower bound of the true k-th score.
2. T goes to all nodes (a join on the query, one row each). Each sends every entry with a partial product >= T / slices;
   a pair that reaches T has at least one such entry.
3. Pairs that lack a partial product get it computed, cell by cell, and the k best exact scores are the answer.

Equal vectors are collapsed before: of a group only the k + 1 smallest ids can be in an answer (ties go to the smaller
id, and one may be the query itself), so a vector that repeats a million times costs no more than k + 1 candidates.

Cases. Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows without an id. A
repeated id counts once, with the least of its vectors. A query with fewer than k candidates gets all of them. Only vectors
of one length have a product, so queries meet candidates of their own length. Scores are exact: products are taken in
floating point where they cannot pass 2^53, else in 64-bit integers, else in integers of any size. A component or score
beyond 64 bits counts as the nearest 64-bit number. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

LEAST, MOST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class TopKSpec:
    k: int = 20
    scale: float = 64.0
    slices: int = 2
    query_block: int = 1024
    candidate_block: int = 4096


def quantised(vectors: DataFrame, scale: float, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v array<long> of the rows that take part: each component becomes floor(scale * x)."""
    e = F.col(embedding).cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & (F.size(e) > 0) & finite)
    ints = F.transform(e, lambda x: F.floor(x * scale))
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), ints.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


BLOCK = "dim int, b long, n long, ids binary, vs binary"


def _packed(rows: DataFrame, block: int, name: str) -> DataFrame:
    """One row per block of vectors of one length: dim, b, n, ids and components as bytes."""

    def pack(t: pa.Table) -> pa.Table:
        ids, flat = t.column("vec_id").to_numpy().astype(np.int64), t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        if -(1 << 31) <= flat.min() and flat.max() < 1 << 31:
            flat = flat.astype(np.int32)
        key = [pa.array([t.column(c)[0].as_py()], kind) for c, kind in (("dim", pa.int32()), ("b", pa.int64()))]
        return pa.table([*key, pa.array([len(ids)], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], names=["dim", "b", "n", "ids", "vs"])

    sized = rows.withColumn("dim", F.size("v"))
    shape = sized.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("blocks"))
    dealt = sized.join(shape, "dim").withColumn("b", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).drop("blocks")
    return materialise(dealt.groupBy("dim", "b").applyInArrow(pack, BLOCK), name)


def _matrix(raw: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32 if len(raw) == 4 * n * dim else np.int64).reshape(n, dim)


def _reach(q: np.ndarray, c: np.ndarray) -> int:
    """No product of rows is larger."""
    most = lambda x: max(abs(int(x.min())), abs(int(x.max()))) if x.size else 0
    return q.shape[1] * most(q) * most(c)


def _node(dim: int, m: int, node: int, reach: int) -> slice:
    """The dimensions of a node. Where scores can pass 64 bits the first has all, so that its partial product is the score."""
    if reach >= 1 << 62:
        return slice(0, dim if node == 0 else 0)
    return slice(dim * node // m, dim * (node + 1) // m)


def _products(q: np.ndarray, c: np.ndarray, reach: int) -> np.ndarray:
    if reach < 1 << 53:
        return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
    if reach < 1 << 62:
        return q.astype(np.int64) @ c.T.astype(np.int64)
    return np.clip(q.astype(object) @ c.T.astype(object), LEAST, MOST).astype(np.int64)


def _pairs(q: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, reach: int) -> np.ndarray:
    """Products of the rows i of q with the rows j of c."""
    out = np.zeros(len(i), np.int64)
    for a in range(0, len(i), 65536):
        x, y = q[i[a : a + 65536]], c[j[a : a + 65536]]
        if reach < 1 << 62:
            out[a : a + 65536] = np.einsum("ij,ij->i", x.astype(np.int64), y.astype(np.int64))
        else:
            out[a : a + 65536] = np.clip((x.astype(object) * y.astype(object)).sum(axis=1), LEAST, MOST).astype(np.int64)
    return out


def _cell(t: pa.Table) -> dict:
    return t.slice(0, 1).to_pylist()[0]


def _opened(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Query rows, candidate rows, their ids, and the reach of their products."""
    q, c = _matrix(r["qvs"], r["qn"], r["dim"]), _matrix(r["vs"], r["n"], r["dim"])
    return q, c, np.frombuffer(r["qids"], np.int64), np.frombuffer(r["ids"], np.int64), _reach(q, c)


def top_k(vectors: DataFrame, is_query: Column, spec: TopKSpec | None = None) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id and v (see quantised); is_query: which of them are queries."""
    spec = spec or TopKSpec()
    k, m = spec.k, spec.slices
    # Of equal vectors the k + 1 smallest ids; the limit is applied before and after the exchange.
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kept = vectors.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    cand = _packed(kept, spec.candidate_block, "candidate-blocks").withColumnRenamed("b", "cb")
    query = _packed(vectors.where(is_query), spec.query_block, "query-blocks").select("dim", F.col("b").alias("qb"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("vs").alias("qvs"))
    nodes = F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("node")
    # The stated query set in blocks goes to every candidate block of its length: an equi-join on (dim, cb, node).
    places = cand.select("dim", "cb", nodes)
    spread = query.join(places, "dim").repartition("dim", "cb", "node")
    grid = cand.select("*", nodes).repartition("dim", "cb", "node").join(spread.hint("merge"), ["dim", "cb", "node"])

    def gather(t: pa.Table) -> pa.Table:
        r = _cell(t)
        q, c, qid, cid, reach = _opened(r)
        part = _node(r["dim"], m, r["node"], reach)
        take, found = min(k, len(cid)), []
        for a in range(0, len(q), 256):  # bounds the matrix
            s = _products(q[a : a + 256, part], c[:, part], reach)
            s[qid[a : a + 256, None] == cid[None, :]] = LEAST
            at = np.argpartition(-s.astype(np.float64), take - 1, axis=1)[:, :take] if take < len(cid) else np.tile(np.arange(take), (len(s), 1))
            i, j = np.repeat(np.arange(len(s)), take), at.ravel()
            fine = qid[a + i] != cid[j]
            i, j = i[fine], j[fine]
            found.append((i + a, j, s[i, j]))
        i, j, s = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([np.full(len(i), r["node"], np.int32), qid[i], cid[j], s, _pairs(q, c, i, j, reach)], names=["node", "q", "c", "s", "exact"])

    local = grid.groupBy("dim", "cb", "node", "qb").applyInArrow(gather, "node int, q long, c long, s long, exact long")
    best = local.withColumn("place", F.row_number().over(Window.partitionBy("q", "node").orderBy(F.desc("s"), "c"))).where(F.col("place") <= k)
    gathered = best.groupBy("q", "c").agg(F.first("exact").alias("exact"))
    ranked = gathered.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("exact"), "c"))).where(F.col("place") <= k)
    # With fewer than k candidates nothing may be cut.
    cutoff = ranked.groupBy("q").agg(F.when(F.count(F.lit(1)) < k, F.lit(LEAST)).otherwise(F.min("exact")).cast("long").alias("t"))
    # One row per query block: cutoffs in the order of its ids.
    ids = query.select("dim", "qb", "qids").mapInArrow(_unpacked, "dim int, qb long, i int, q long")
    packed = ids.join(cutoff, "q", "left").groupBy("dim", "qb").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.coalesce("t", F.lit(LEAST)).alias("t")))), lambda x: x["t"]).alias("ts"))
    packed = materialise(packed, "cutoffs")

    def collect(t: pa.Table) -> pa.Table:
        r = _cell(t)
        q, c, qid, cid, reach = _opened(r)
        part = _node(r["dim"], m, r["node"], reach)
        least, out = -(-np.array(r["ts"], np.int64) // m), []  # s >= T / m in whole numbers
        least = np.where(np.array(r["ts"], np.int64) == LEAST, LEAST, least)
        for a in range(0, len(q), 256):
            s = _products(q[a : a + 256, part], c[:, part], reach)
            i, j = np.nonzero((s >= least[a : a + 256, None]) & (qid[a : a + 256, None] != cid[None, :]))
            out.append(((i + a).astype(np.int64) * len(cid) + j, s[i, j]))
        at, s = (np.concatenate(x) for x in zip(*out, strict=True))
        key = [pa.array([r[x]], kind) for x, kind in (("dim", pa.int32()), ("qb", pa.int64()), ("cb", pa.int64()), ("node", pa.int32()))]
        return pa.table([*key, pa.array([at.tobytes()], pa.binary()), pa.array([s.tobytes()], pa.binary())], names=["dim", "qb", "cb", "node", "at", "s"])

    # A node's entries for a cell travel as one row: places (query row * block size + candidate row) and partial products.
    cutoffs = packed.join(places, "dim").repartition("dim", "cb", "node")
    cells = grid.join(cutoffs.hint("merge"), ["dim", "cb", "node", "qb"])
    sent = cells.groupBy("dim", "cb", "node", "qb").applyInArrow(collect, "dim int, qb long, cb long, node int, at binary, s binary")
    listed = sent.groupBy("dim", "qb", "cb").agg(F.sort_array(F.collect_list(F.struct("node", "at", "s"))).alias("lists"))
    # What a cell lacks is resolved where both blocks are at hand; a cell's lists are bounded by the two block sizes.
    final = listed.join(cand, ["dim", "cb"]).join(query, ["dim", "qb"])

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(x, 1).to_pylist()[0] for x in range(batch.num_rows)):
                q, c, qid, cid, reach = _opened(r)
                lists = {x["node"]: (np.frombuffer(x["at"], np.int64), np.frombuffer(x["s"], np.int64)) for x in r["lists"]}
                at = np.unique(np.concatenate([a for a, _ in lists.values()]))
                i, j, s = at // len(cid), at % len(cid), np.zeros(len(at), np.int64)
                for node in range(m):
                    part = _node(r["dim"], m, node, reach)
                    lack = np.ones(len(at), bool)
                    if node in lists:
                        have = np.searchsorted(at, lists[node][0])
                        s[have] += lists[node][1]
                        lack[have] = False
                    lack = np.nonzero(lack)[0]
                    s[lack] += _pairs(q[:, part], c[:, part], i[lack], j[lack], reach)
                # The k best of a query in this cell are enough.
                order = np.lexsort((cid[j], -(s + 1), i))  # s + 1: the least number has no negative
                i, j, s = i[order], j[order], s[order]
                place = np.arange(len(i)) - np.searchsorted(i, i)
                i, j, s = (x[place < k] for x in (i, j, s))
                yield pa.RecordBatch.from_arrays([pa.array(qid[i]), pa.array(cid[j]), pa.array(s)], ["query_id", "vec_id", "score"])

    exact = final.mapInArrow(resolve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return exact.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in (batch.slice(x, 1).to_pylist()[0] for x in range(batch.num_rows)):
            ids = np.frombuffer(r["qids"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["dim"], np.int32)), pa.array(np.full(len(ids), r["qb"])), pa.array(np.arange(len(ids), dtype=np.int32)), pa.array(ids)], ["dim", "qb", "i", "q"])

"""Near-duplicate documents by min-max hashing, with links confirmed on whole shingle sets.

1. Signatures. A document's set of n-word shingles gives, for each permutation, the minimum and the maximum: two values
   for one hash evaluation. Values are banded; documents that share a band are candidates. With 64 permutations and bands
   of 4 of the 128 values a pair at similarity 0.8 is missed with a probability of about 5 in 10^8.
2. Classes. Documents with equal sets are one class, named by a 128-bit digest of the set, before anything is paired:
   copies, however many, cost one row per map task. From here on only digests and sets of hashes travel, no texts.
3. Stars. In every bucket each member is compared with one centre, the member that meets most others. Links are decided
   on the sets themselves.
4. Components of these links by alternating large and small stars; labels stay distributed and each round is written.
5. Rest. Members of one centre's cluster that ended in different components have only been compared with the centre. Of
   these the sets are joined exactly: two sets of similarity t share one of the n - ceil(t n) + 1 rarest shingles of
   each. Shingles that few sets have rare among their own give pairs; those of many are compared block by block, so a
   common passage meets in no task as a whole, and no link between members of a bucket is lost.

Cases. Null and empty texts have an empty set and are linked with nothing, not even each other. A text of fewer than n
words is one shingle. Equal sets are linked. Rows that repeat a doc_id with the same text are one document and each row
is returned; rows of one doc_id with different texts are different documents, which share the id. A null doc_id is
returned alone, unlinked. An empty table gives an empty result. Columns beyond doc_id and text are ignored by
``components`` and returned unchanged by ``drop_near_copies``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shingles
from .common import chunks_of, discard, lean, materialise, without


#: A pair of sets is some 5 kB, of very long texts 300 kB and more; those of one centre stand together.
PAIRS_PER_BATCH = 64


@dataclass(frozen=True)
class NearSpec:
    """words per shingle; similarity as a ratio of integers; permutations and values per band; rows per block and most
    sets of a shingle that are paired; most candidates that are broadcast."""

    words: int = 5
    similar: int = 80
    of: int = 100
    permutations: int = 64
    rows: int = 4
    block: int = 256
    paired: int = 32
    broadcast_ids: int = 1_000_000


def _sets(batch: pa.RecordBatch, words: int) -> list[np.ndarray]:
    return shingles.sets_of([shingles.lowered(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], words)


def _digests(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([np.array(shingles.set_digest(x), np.int64).tobytes() for x in sets], pa.binary())


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in column]


def signatures(docs: DataFrame, spec: NearSpec, name: Column | None = None) -> DataFrame:
    """doc_id, name, n, k (digest of the set), bands (null for empty sets): one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks_of(batches, "text", 1_500_000):
            sets = _sets(batch, spec.words)
            size = np.array(list(map(len, sets)), np.int64)
            full = np.nonzero(size)[0]
            bands = np.zeros((0, 1), np.int64)
            if len(full):
                bands = shingles.band_keys(shingles.min_max([sets[i] for i in full], spec.permutations), spec.rows).view(np.int64)
            ends = np.concatenate([[0], np.cumsum((size > 0) * bands.shape[1])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size), _digests(sets), lists], ["doc_id", "name", "n", "k", "bands"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lit(0) if name is None else name).cast("long").alias("name"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, name long, n long, k binary, bands array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, spec: NearSpec) -> DataFrame:
    """k and s, the sorted shingle hashes, of the sets whose digests are in ids (k, doc_id): a row for each, more where a
    doc_id repeats."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(ids.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks_of(batches, "text", 1_500_000):
            sets = _sets(batch, spec.words)
            yield pa.RecordBatch.from_arrays([_digests(sets), _lists(sets)], ["k", "s"])

    made = texts.mapInArrow(run, "k binary, s array<long>")
    return made.join(ids.select("k"), "k", "left_semi")  # an id's other texts may be no candidates


def linked_pairs(pairs: DataFrame, sets: DataFrame, spec: NearSpec) -> DataFrame:
    """Of pairs (a, b) those whose sets are similar enough."""
    held = pairs.join(sets.select(F.col("k").alias("b"), F.col("s").alias("bs")), "b").join(sets.select(F.col("k").alias("a"), F.col("s").alias("xs")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(_arrays(batch.column(2)), _arrays(batch.column(3)), strict=True)):
                both = shingles.overlap(x, y)
                if spec.of * both >= spec.similar * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return held.select("a", "b", "xs", "bs").mapInArrow(run, "a binary, b binary")


def connected(edges: DataFrame) -> DataFrame:
    """(v, component) of the vertices of edges (a, b) but the smallest of each component, which is its name."""
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Now every pair points to a smaller vertex; small stars link a vertex's smaller neighbours with the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        old, now = now, materialise(small.distinct(), "edges")
        discard(old)
    return now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "v")


def _rest(star: DataFrame, labels: DataFrame, sets: DataFrame, spec: NearSpec) -> DataFrame:
    """Links (a, b) between members of a centre's cluster that lie in different components."""
    members = star.select("z", "x").union(star.select("z", F.col("z").alias("x")).distinct())
    named = members.join(labels.select(F.col("v").alias("x"), "component"), "x", "left").withColumn("component", F.coalesce("component", "x"))
    named = materialise(named, "cluster-members")
    shape = named.groupBy("z").agg(F.count(F.lit(1)).alias("m"), (F.min("component") != F.max("component")).alias("open"))
    # With two members there is only the pair with the centre, which has been judged. Written apart from the members, so that
    # a large cluster's rows are not drawn into the task that counts them.
    wide = materialise(shape.where("open AND m > 2").select("z"), "open-clusters")
    wide = F.broadcast(wide) if wide.count() <= spec.broadcast_ids else wide
    open_ = named.join(wide, "z", "left_semi").select("x", "component").distinct()
    held = materialise(open_.join(sets.withColumnRenamed("k", "x"), "x"), "open-sets")
    # How many sets have a shingle, and whether they lie in several components; shingles of one set come first in the order.
    seen = held.select(F.explode("s").alias("t"), "component").groupBy("t").agg(F.count(F.lit(1)).alias("df"), (F.min("component") != F.max("component")).alias("apart")).where("df > 1")
    seen = materialise(seen, "shingle-counts")
    n = F.size("s")
    shared = held.select("x", "component", n.alias("n"), F.explode("s").alias("t")).join(seen.hint("merge"), "t")
    order = Window.partitionBy("x").orderBy("df", "t")
    alone = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy("x"))
    # ceil(similar * n / of) in whole numbers
    prefix = F.col("n") - F.floor((F.lit(spec.similar) * F.col("n") + (spec.of - 1)) / spec.of) + 1
    rare = shared.withColumns({"place": F.row_number().over(order), "alone": alone}).where(F.col("place") + F.col("alone") <= prefix).where("apart").select("t", "x", "component", "n")
    rare = materialise(rare, "rare-shingles")
    groups = rare.groupBy("t").agg(F.count(F.lit(1)).alias("m"), (F.min("component") != F.max("component")).alias("apart")).where("apart").drop("apart")
    groups = materialise(groups, "shingle-groups")
    few = rare.join(groups.where(F.col("m") <= spec.paired).select("t"), "t")
    other = few.select("t", F.col("x").alias("y"), F.col("component").alias("other"), F.col("n").alias("yn"))
    pairs = few.join(other, "t").where((F.col("x") < F.col("y")) & (F.col("component") != F.col("other")) & (spec.of * F.least("n", "yn") >= spec.similar * F.greatest("n", "yn")))
    found = linked_pairs(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), sets, spec)
    # Shingles of many sets: those outside the largest component meet all others, block by block.
    many = rare.join(groups.where(F.col("m") > spec.paired).select("t"), "t")
    per = many.groupBy("t", "component").agg(F.count(F.lit(1)).alias("m"))
    sizes = per.groupBy("t").agg(F.sum("m").alias("all"), F.max(F.struct("m", "component")).alias("main"))
    sizes = sizes.select("t", F.col("main.component").alias("main"), F.ceil(F.col("all") / spec.block).cast("int").alias("blocks"), F.ceil((F.col("all") - F.col("main.m")) / spec.block).cast("int").alias("odd_blocks"))
    cells = many.join(sizes, "t")
    block = lambda c: F.pmod(F.xxhash64("x"), F.col(c)).cast("int")
    odd = cells.where("component <> main").withColumns({"i": block("odd_blocks"), "j": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "odd": F.lit(True)})
    every = cells.withColumns({"j": block("blocks"), "i": F.explode(F.sequence(F.lit(0), F.col("odd_blocks") - 1)), "odd": F.lit(False)})
    names = ["t", "i", "j", "odd", "x", "component"]
    cells = odd.select(*names).union(every.select(*names)).join(sets.withColumnRenamed("k", "x"), "x")

    def compare(t: pa.Table) -> pa.Table:
        return _across(np.array(t.column("odd").to_pylist(), bool), t.column("x").to_pylist(), t.column("component").to_pylist(), _arrays(t.column("s").combine_chunks()), spec)

    return found.union(cells.groupBy("t", "i", "j").applyInArrow(compare, "a binary, b binary"))


def _across(odd: np.ndarray, ids: list[bytes], component: list[bytes], sets: list[np.ndarray], spec: NearSpec, most: int = 1_000_000) -> pa.Table:
    """Links between the odd rows and the others that lie in different components, sets of most hashes at a time."""
    size = np.array(list(map(len, sets)), np.int64)
    _, comp = np.unique(np.array(component, object), return_inverse=True)

    def parts(rows: np.ndarray) -> list[np.ndarray]:
        return np.split(rows, np.nonzero(np.diff(np.cumsum(size[rows]) // most))[0] + 1) if len(rows) else []

    out: list[tuple[bytes, bytes]] = []
    for left in parts(np.nonzero(odd)[0]):
        for right in parts(np.nonzero(~odd)[0]):
            i, j = _links([sets[x] for x in left], [sets[x] for x in right], spec)
            far = comp[left[i]] != comp[right[j]]
            out += [(ids[left[x]], ids[right[y]]) for x, y in zip(i[far], j[far], strict=True)]
    return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})


def _links(left: list[np.ndarray], right: list[np.ndarray], spec: NearSpec) -> tuple[np.ndarray, np.ndarray]:
    """Places of the similar pairs of two lists of sets, by products of incidence matrices of the hashes that repeat."""
    sets, n = left + right, len(left)
    size = np.array(list(map(len, sets)), np.int64)
    where = np.repeat(np.arange(len(sets)), size)
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = df > 1
    fine = common[code]
    where, code = where[fine], (np.cumsum(common) - 1)[code[fine]]
    order = np.argsort(code, kind="stable")
    where, code = where[order], code[order]
    both, step = np.zeros((n, len(right)), np.float32), 8192  # columns of the matrices at a time
    for a in range(0, int(common.sum()), step):
        lo, hi = np.searchsorted(code, [a, a + step])
        m = np.zeros((len(sets), step), np.float32)
        m[where[lo:hi], code[lo:hi] - a] = 1
        both += m[:n] @ m[n:].T
    both = both.astype(np.int64)
    return np.nonzero(spec.of * both >= spec.similar * (size[:n, None] + size[None, n:] - both))


def components(docs: DataFrame, spec: NearSpec | None = None, name: Column | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (and name, a number that tells rows of one doc_id apart, if given): one row per
    row of docs."""
    spec = spec or NearSpec()
    with lean(docs.sparkSession):
        sig = materialise(signatures(docs, spec, name), "signatures")
        one = sig.where("n > 0 AND doc_id IS NOT NULL").groupBy("k").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("n").alias("n"))
        classes = materialise(one, "set-classes")
        bands = classes.select("k", "n", F.explode("bands").alias("bucket"))
        counts = bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        held = materialise(bands.join(counts, "bucket"), "buckets")
        degree = held.groupBy("k").agg(F.sum("m").alias("degree"))
        centre = held.join(degree, "k").groupBy("bucket").agg(F.max(F.struct("degree", "k", "n")).alias("c"))
        centre = materialise(centre.select("bucket", F.col("c.k").alias("z"), F.col("c.n").alias("zn")), "centres")
        star = held.join(centre, "bucket").where("k <> z").groupBy("z", F.col("k").alias("x")).agg(F.first("n").alias("n"), F.first("zn").alias("zn"))
        star = materialise(star, "stars")
        meant = star.select(F.col("x").alias("k")).union(star.select("z")).distinct()
        meant = materialise(classes.join(meant, "k", "left_semi").select("k", "doc_id"), "candidates")
        # So many (24 bytes each) are sent to the texts; more are joined by an exchange of both.
        wanted = meant.count()
        sets = materialise(shingle_sets(docs, F.broadcast(meant) if wanted <= spec.broadcast_ids else meant, spec), "candidate-sets")
        if sets.count() != wanted:  # ids repeat with one text
            sets = materialise(sets.groupBy("k").agg(F.first("s").alias("s")), "candidate-sets")
        able = star.where(spec.of * F.least("n", "zn") >= spec.similar * F.greatest("n", "zn")).select(F.col("z").alias("a"), F.col("x").alias("b"))
        with lean(docs.sparkSession, PAIRS_PER_BATCH):
            edges = materialise(linked_pairs(able, sets, spec), "links")
            labels = materialise(connected(edges), "components")
            more = materialise(_rest(star, labels, sets, spec), "more-links")
        if not more.isEmpty():
            labels = materialise(connected(edges.union(more)), "components")
    # A component's id is the smallest doc_id of its classes.
    every = labels.union(labels.select(F.col("component").alias("v"), "component").distinct())
    named = classes.select("k", "doc_id").join(every.withColumnRenamed("v", "k"), "k")
    least = named.groupBy("component").agg(F.min("doc_id").alias("c"))
    alone = classes.join(every.select(F.col("v").alias("k")), "k", "left_anti").select("k", F.col("doc_id").alias("c"))
    named = materialise(named.join(least, "component").select("k", "c").union(alone), "class-components")
    discard(classes, held, centre, star, meant, sets, edges, labels, more)
    out = sig.join(named, "k", "left")
    component = F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("c", "doc_id"))
    tags = [] if name is None else ["name"]
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), *tags)


def drop_near_copies(docs: DataFrame, spec: NearSpec | None = None) -> DataFrame:
    """docs with one document of each component, the one with the smallest doc_id."""
    spec = spec or NearSpec()
    print_ = F.xxhash64("text")
    gone = materialise(components(docs, spec, print_).where("NOT kept").select("doc_id", "name").distinct(), "near-copies")
    return without(docs, gone, {"doc_id": F.col("doc_id").cast("long"), "name": print_}, spec.broadcast_ids)

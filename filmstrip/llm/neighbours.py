"""Nearest neighbours by multiprobe p-stable hashing, exact scores in the end.

Rows are lengthened to one common length by a further component, so that the largest
inner product is the smallest Euclidean distance; both sides are scaled to length 1. A
table's bucket is made of k quantised projections on Gaussian vectors. A query visits,
in each table, the buckets around its own in the order of the probability that a row at
the distance of its neighbours is there: a product over projections, so the likeliest
buckets are found by keeping the best part-products from projection to projection. All
rows in visited buckets are candidates, candidates of all tables are merged, and their
exact inner products rank them.

How many buckets have to be visited is measured: a bounded sample of queries is compared
with all rows, and the number is the smallest at which ``RECALL`` of their neighbours
are met. Where no number within ``MOST`` is enough, and where a query has met fewer rows
than it asks for, all rows are visited.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, drawn, lengths, meet, merged, packed, packed_schema, usable_vectors, vectors_of
from .common import staged

TABLES, WIDTH, CROWD, MOST, RECALL = 4, 1.5, 64, 4096, 0.97
#: Queries that the number of probes is measured on, rows that give first bounds, rows of
#: a block, offsets of a projection's cell to either side.
TRIED, SAMPLE, BLOCK, REACH = 128, 4096, 16_384, 3
#: Rounding allowed for where products of blocks are compared with a bound, of both lengths.
SLACK = 1e-11

_erf = np.frompyfunc(math.erf, 1, 1)


def _below(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + _erf(np.clip(z, -8.0, 8.0) / math.sqrt(2.0)).astype(np.float64))


def projections(rows: int, crowd: int = CROWD, width: float = WIDTH) -> int:
    """Projections of a table, for about ``crowd`` rows a bucket: each divides vectors of
    length 1 (a projection has the deviation 1) into exp(entropy) cells."""
    cells = math.sqrt(2 * math.pi * math.e) / width
    return max(2, round(math.log(max(rows / crowd, 1)) / math.log(max(cells, 1.5))))


class Tables:
    """The hash functions. Rows of ``dim`` components at most ``unit`` are divided by it
    and lengthened to the length sqrt(most)."""

    def __init__(self, dim: int, k: int, tables: int, unit: float, most: float, width: float = WIDTH, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.unit, self.most, self.k, self.tables, self.width = unit, most, k, tables, width
        self.a = rng.standard_normal((dim + 1, tables * k))
        self.b = rng.uniform(0, width, tables * k)

    def lifted(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Vectors of length 1 whose distances order as inner products do."""
        if query:
            x = x / np.abs(x).max(axis=1)[:, None]
            return np.c_[x / np.sqrt((x * x).sum(axis=1))[:, None], np.zeros(len(x))]
        x = x / self.unit
        return np.c_[x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0.0))] / math.sqrt(self.most)

    def _at(self, x: np.ndarray, query: bool) -> np.ndarray:
        """Places on the projections, in cells."""
        return (self.lifted(x, query) @ self.a + self.b) / self.width

    def _mixed(self, cells: np.ndarray, h: np.ndarray, j: int) -> np.ndarray:
        h = (h ^ (cells.astype(np.int64).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 + j))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def _seed(self, t: int) -> np.uint64:
        return np.uint64(0x632BE59BD9B4E019 * (t + 1) % (1 << 64))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """Bucket numbers, rows by tables."""
        cells = np.floor(self._at(x, False))
        out = np.empty((len(x), self.tables), np.uint64)
        for t in range(self.tables):
            h = np.full(len(x), self._seed(t))
            for j in range(self.k):
                h = self._mixed(cells[:, t * self.k + j], h, j)
            out[:, t] = h
        return out.view(np.int64)

    def probes(self, q: np.ndarray, t: int, many: int, distance: float) -> np.ndarray:
        """The ``many`` likeliest buckets of table t for each query, in that order."""
        at = self._at(q, True)[:, t * self.k : (t + 1) * self.k]
        home, offsets = np.floor(at), np.arange(-REACH, REACH + 1)
        low = (home[:, :, None] + offsets - at[:, :, None]) * (self.width / distance)
        chance = np.log(np.maximum(_below(low + self.width / distance) - _below(low), 1e-300))
        score, h = np.zeros((len(q), 1)), np.full((len(q), 1), self._seed(t))
        for j in range(self.k):
            score = (score[:, :, None] + chance[:, j, None, :]).reshape(len(q), -1)
            h = self._mixed(np.broadcast_to(home[:, j, None, None] + offsets, (len(q), h.shape[1], len(offsets))), np.broadcast_to(h[:, :, None], (len(q), h.shape[1], len(offsets))), j).reshape(len(q), -1)
            if score.shape[1] > many:
                keep = np.argpartition(-score, many - 1, axis=1)[:, :many]
                score, h = np.take_along_axis(score, keep, 1), np.take_along_axis(h, keep, 1)
        order = np.argsort(-score, axis=1, kind="stable")
        return np.take_along_axis(h, order, 1).view(np.int64)


def _score(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs, each by itself: the same whatever block it is in."""
    return (q * x).sum(axis=1)


def neighbours(vectors: DataFrame, queries: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", *, most: int = 20, recall: float = RECALL, tables: int = TABLES, width: float = WIDTH, probes: int = MOST, rows_per_block: int = BLOCK, sample: int = SAMPLE, tried: int = TRIED) -> DataFrame:
    """query_id, rank, vec_id, score: of each query the ``most`` nearest found.

    ``queries`` says of ``id`` which rows are queries; candidates are all other rows. The
    nearest have the largest inner product, in double precision; ties go to the smaller
    id. Rows without an id and vectors that are null, empty, zero, or have null or
    non-finite components take no part. Rows are rows also where they repeat an id or a
    vector, so a query's copies are its candidates. Vectors of different lengths aren't
    compared. A query alone in its table has no rows; an empty table gives none. Other
    columns are ignored."""
    rows = usable_vectors(vectors, id_col, vector_col).where("exists(vector, x -> x != 0)")
    parts = [_of_length(rows.where(F.size("vector") == dim), dim, n, queries, most, recall, tables, width, probes, rows_per_block, sample, tried) for dim, n in lengths(rows)]
    if not parts:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _truth(rows: DataFrame, asked: np.ndarray, asked_row: np.ndarray, most: int, slack: np.ndarray) -> dict[int, list[int]]:
    """The rows of the true neighbours of a few queries, by comparing with all rows."""

    def task(batches):
        q = row = ids = neg = np.zeros(0, np.int64)
        for b in batches:
            x, r, i = vectors_of(b.column("vector")), b.column("row").to_numpy(), b.column("id").to_numpy()
            at, j = _near(asked @ x.T, asked_row[:, None] != r, np.full(len(asked), -np.inf), slack, most)
            q, row, ids, neg = np.r_[q, at], np.r_[row, r[j]], np.r_[ids, i[j]], np.r_[neg, -_score(asked[at], x[j])]
            keep = best(q, neg, ids, most)
            q, row, ids, neg = q[keep], row[keep], ids[keep], neg[keep]
        if len(q):
            yield packed([np.arange(len(asked))], [0], q, neg, ids, row, pa.float64())

    partial = rows.select("row", "id", "vector").mapInArrow(task, packed_schema(1, "double"))
    partial = partial.withColumn("slot", F.pmod(F.spark_partition_id(), F.lit(1 << 12)).cast("long"))
    found = merged(partial, ["k0"], 1 << 12, most)
    return {r[0]: r[1] for r in found.select("k0", F.transform("best", lambda x: x["row"])).collect()}


def _near(scores: np.ndarray, other: np.ndarray, least: np.ndarray, slack: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that may be among the first ``most`` of their query and reach its least."""
    scores = np.where(other, scores, -np.inf)
    bound = least - slack
    if scores.shape[1] > 2 * most:
        bound = np.maximum(bound, np.partition(scores, -most, axis=1)[:, -most] - slack)
    return np.nonzero((scores >= bound[:, None]) & other)


def _fitted(hashed: DataFrame, q: pa.Table, hashing: Tables, most: int, recall: float, probes: int, slack) -> tuple[int, float]:
    """How many buckets of each table are to be visited, 0 for all rows, and the
    distance at which neighbours are looked for: the middle one of those found."""
    asked, asked_row = vectors_of(q.column("vector")), q.column("row").to_numpy()
    truth = _truth(hashed, asked, asked_row, most, slack(asked))
    spark = hashed.sparkSession
    wanted = spark.createDataFrame(pa.table({"row": pa.array(sorted({r for rs in truth.values() for r in rs}), pa.int64())}))
    found = hashed.join(F.broadcast(wanted), "row").select("row", "vector", "buckets").toArrow()  # at most tried * most rows
    if not found.num_rows:
        return 0, 1.0
    place = {r: k for k, r in enumerate(found.column("row").to_pylist())}
    buckets = np.array(found.column("buckets").to_pylist(), np.int64)
    lifted, own = hashing.lifted(vectors_of(found.column("vector")), False), hashing.lifted(asked, True)
    pairs = [(k, place[r]) for k, rs in sorted(truth.items()) for r in rs]
    apart = np.sqrt([max(2 - 2 * float(own[k] @ lifted[r]), 0.0) for k, r in pairs])
    distance = max(float(np.median(apart)), 0.05)
    rank = np.full(len(pairs), np.inf)
    for t in range(hashing.tables):
        keys = hashing.probes(asked, t, probes, distance)
        for n, (k, r) in enumerate(pairs):
            hit = np.flatnonzero(keys[k] == buckets[r, t])
            if len(hit):
                rank[n] = min(rank[n], hit[0])
    needed = np.sort(rank)[math.ceil(recall * len(rank)) - 1]
    return (int(needed) + 1 if np.isfinite(needed) else 0), distance


def _of_length(rows: DataFrame, dim: int, n: int, queries, most: int, recall: float, tables: int, width: float, probes: int, rows_per_block: int, sample: int, tried: int) -> DataFrame:
    unit = rows.agg(F.max(F.expr("array_max(transform(vector, x -> abs(x)))"))).first()[0]
    longest = rows.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / unit) * (x / unit)))).first()[0]
    hashing = Tables(dim, projections(n, width=width), tables, unit, longest, width)
    slack = lambda q: SLACK * unit * math.sqrt(longest) * np.sqrt((q * q).sum(axis=1))
    some = drawn(rows, sample, n).select("row", "vector").toArrow()
    known, known_row = (vectors_of(some.column("vector")), some.column("row").to_numpy()) if some.num_rows else (np.zeros((0, dim)), np.zeros(0, np.int64))

    def bucketed(batches):
        for b in batches:
            keys = hashing.buckets(vectors_of(b.column("vector")))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * tables, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], names=[*b.schema.names, "buckets"])

    hashed = staged(rows.select("row", "id", "vector").mapInArrow(bucketed, "row long, id long, vector array<double>, buckets array<long>"), "hashed")
    asking = rows.where(queries).select("row", "id", "vector")
    q = drawn(asking, tried, asking.count()).toArrow()
    many, distance = _fitted(hashed, q, hashing, most, recall, probes, slack) if q.num_rows else (0, 1.0)

    bins = max(1, -(-n // rows_per_block))
    dealt = hashed.select("row", "id", "vector", F.posexplode("buckets").alias("t", "bucket")).withColumn("bin", F.pmod(F.shiftrightunsigned("bucket", 11), F.lit(bins)))
    # a bin that holds a crowded bucket is cut into parts
    parts = staged(dealt.groupBy("t", "bin").agg(F.ceil(F.count(F.lit(1)) / rows_per_block).cast("int").alias("parts")), "bins")
    blocks = int(parts.agg(F.sum("parts")).first()[0])
    number = (F.col("t") * bins + F.col("bin")) * (1 << 20)
    placed = dealt.join(parts, ["t", "bin"]).select((number + F.pmod(F.xxhash64("row", F.lit(1)), F.col("parts"))).alias("block"), "row", "id", "vector", "bucket")

    def bounded(b):
        """Its exact scores on the sample say what a query has at least."""
        x, own = vectors_of(b.column("vector")), b.column("row").to_numpy()
        least = np.full(len(x), -np.inf)
        if len(known) > most:
            least = np.partition(np.where(own[:, None] != known_row, x @ known.T, -np.inf), -most, axis=1)[:, -most]
        return x, pa.array(least)

    def visits(batches):
        """A row for each bin that holds buckets of a query, with those buckets."""
        for whole in batches:
            for start in range(0, whole.num_rows, 128):
                b = whole.slice(start, 128)
                x, least = bounded(b)
                for t in range(tables):
                    keys = hashing.probes(x, t, many, distance)
                    bin_of = ((keys.view(np.uint64) >> np.uint64(11)) % np.uint64(bins)).astype(np.int64)
                    at = np.repeat(np.arange(len(x)), keys.shape[1])
                    order = np.lexsort((bin_of.ravel(), at))
                    at, bin_at, keys = at[order], bin_of.ravel()[order], keys.ravel()[order]
                    first = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(bin_at) != 0)])
                    to = pa.array(at[first])
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(at)], pa.int32()), pa.array(keys))
                    yield pa.RecordBatch.from_arrays([b.column("row").take(to), b.column("vector").take(to), least.take(to), pa.array(np.full(len(first), t)), pa.array(bin_at[first]), lists], names=["row", "vector", "least", "t", "bin", "buckets"])

    def everywhere(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vector"), bounded(b)[1]], names=["row", "vector", "least"])

    def load(t):
        order = np.argsort(t.column("bucket").to_numpy(), kind="stable")
        t = t.take(pa.array(order)).combine_chunks()
        bucket = t.column("bucket").to_numpy()
        start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        return vectors_of(t.column("vector")), t.column("row").to_numpy(), t.column("id").to_numpy(), bucket[start], np.r_[start, len(bucket)]

    def task(block, b, at):
        x, row, ids, bucket, edge = block
        q, own, least = vectors_of(b.column("vector")), b.column("row").to_numpy(), b.column("least").to_numpy()
        lists, margin = b.column("buckets"), slack(q)
        pairs = []
        if lists.null_count:  # every row is visited
            pairs.append(_near(q @ x.T, own[:, None] != row, least, margin, most))
        else:
            of = np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy()))
            keys = lists.flatten().to_numpy()
            k = np.minimum(np.searchsorted(bucket, keys), len(bucket) - 1)
            hit = bucket[k] == keys
            of, k = of[hit], k[hit]
            order = np.argsort(k, kind="stable")
            of, k = of[order], k[order]
            cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else []
            for a, z in zip(cut, np.r_[cut[1:], len(k)] if len(k) else []):
                some, here = of[a:z], slice(edge[k[a]], edge[k[a] + 1])
                i, j = _near(q[some] @ x[here].T, own[some, None] != row[here], least[some], margin[some], most)
                pairs.append((some[i], j + here.start))
        i, j = (np.concatenate([p[m] for p in pairs]) if pairs else np.zeros(0, np.int64) for m in (0, 1))
        neg = -_score(q[i], x[j])
        keep = best(i, neg, ids[j], most)
        if len(keep):
            i, j = i[keep], j[keep]
            slot = (at * 0x9E3779B97F4A7C15 % (1 << 64) >> 20) % blocks
            yield packed([own], [slot], i, neg[keep], ids[j], row[j], pa.float64())

    def found(asked):
        """The lists of queries given with the bins, and buckets, that they visit."""
        to = asked.join(parts, ["t", "bin"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        met = meet(placed, to.select((number + F.col("part")).alias("block"), "row", "vector", "least", "buckets"), load, task, packed_schema(1, "double"))
        return staged(merged(met, ["k0"], blocks, most).withColumnRenamed("k0", "row"), "found")

    def whole(some):
        each = some.mapInArrow(everywhere, "row long, vector array<double>, least double")
        return found(each.withColumns({"t": F.lit(0).cast("long"), "bin": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))), "buckets": F.lit(None).cast("array<long>")}))

    if many:
        out = found(asking.mapInArrow(visits, "row long, vector array<double>, least double, t long, bin long, buckets array<long>"))
        short = staged(asking.join(out.where(F.size("best") >= min(most, n - 1)), "row", "left_anti"), "short")
        if not short.isEmpty():
            out = out.join(short, "row", "left_anti").union(whole(short))
    else:
        out = whole(asking)
    out = out.join(asking.select("row", F.col("id").alias("query_id")), "row").select("query_id", F.posexplode("best").alias("rank", "n"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("vec_id"), (F.lit(0.0) - F.col("n.neg")).alias("score"))

"""Hard negatives by inner product: a pivot table over augmented vectors.

A further component sqrt(M - |x|^2) on every row, with M the largest squared length, and
0 on every anchor, turns inner products into Euclidean distances: |q - x|^2 is
|q|^2 + M - 2 q.x. Each row's distances to a few pivots are stored once. By the triangle
inequality they put bounds on an anchor's distance to a row, and so on its score: a row
whose best possible score is below what the anchor already has, or whose score can't be
in any wanted range, is passed over; scores of all others are computed exactly. What an
anchor already has at first are its exact scores on a bounded sample of rows.

Components are whole numbers. Sums stay below 2^53 where lengths allow, else Python's
whole numbers are used, so that scores are exact always.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import best, drawn, lengths, meet, merged, packed, packed_schema, usable_vectors, vectors_of
from .common import staged

#: Pivots, rows of the sample that pivots and first bounds come from, rows of a block.
PIVOTS, SAMPLE, BLOCK = 16, 2048, 8192
#: Squared lengths from which a score might not fit a long.
LARGEST = float(1 << 62)
#: Below this share of surviving pairs, only those are computed.
SPARSE = 0.2
NONE = -(1 << 63)


def _exact(x: np.ndarray, most: float) -> np.ndarray:
    """Whole components as doubles if every sum of products is exact, else as objects."""
    return x if most < 2.0**53 else np.frompyfunc(int, 1, 1)(x)


def _apart(dots: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Distances from inner products and squared lengths, rows by columns."""
    return np.sqrt(np.maximum(own[:, None] + other[None, :] - 2.0 * dots, 0.0))


class Pivots:
    """Pivots by farthest-first choice from a sample of vectors, augmented for ``most``."""

    def __init__(self, sample: np.ndarray, most: float, many: int = PIVOTS):
        self.most = float(most)
        lifted = self._lifted(sample)
        chosen, far = [0], np.full(len(sample), np.inf)
        while len(chosen) < min(many, len(sample)):
            far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(axis=1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.points = lifted[chosen]

    def _lifted(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0.0))]

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots; all lie on a sphere."""
        return _apart(self._lifted(x) @ self.points.T, np.full(len(x), self.most), np.full(len(self.points), self.most))

    def of_anchors(self, q: np.ndarray) -> np.ndarray:
        return _apart(q @ self.points[:, :-1].T, (q * q).sum(axis=1), np.full(len(self.points), self.most))

    def brackets(self, q: np.ndarray, near_q: np.ndarray, near_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds on scores, anchors by rows, widened by what rounding may cost."""
        low = np.zeros((len(near_q), len(near_x)))
        high = np.full(low.shape, np.inf)
        for p in range(len(self.points)):
            np.maximum(low, np.abs(near_q[:, p, None] - near_x[None, :, p]), out=low)
            np.minimum(high, near_q[:, p, None] + near_x[None, :, p], out=high)
        own = (q * q).sum(axis=1)[:, None] + self.most
        slack = 1e-6 * own + 1e-6
        return (own - high * high) / 2 - slack, (own - low * low) / 2 + slack


def _scores(q: np.ndarray, x: np.ndarray, most: float, wanted: np.ndarray) -> np.ndarray:
    """Exact scores where wanted, anchors by rows; elsewhere anything."""
    q, x = _exact(q, most), _exact(x, most)
    if q.dtype != object and wanted.mean() > SPARSE:
        return q @ x.T
    out = np.zeros(wanted.shape, q.dtype)
    i, j = np.nonzero(wanted)
    for a in range(0, len(i), 1 << 16):
        s = slice(a, a + (1 << 16))
        out[i[s], j[s]] = (q[i[s]] * x[j[s]]).sum(axis=1)
    return out


def _first(scores: np.ndarray, wanted: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``most`` wanted rows of each anchor: anchor, row, score, in order."""
    if scores.dtype != object and scores.shape[1] > 4 * most:
        masked = np.where(wanted, scores, -np.inf)
        wanted = wanted & (masked >= np.partition(masked, -most, axis=1)[:, -most, None])
    i, j = np.nonzero(wanted)
    s = np.array([int(v) for v in scores[i, j]], np.int64)
    keep = best(i, -s, ids[j], most)
    return i[keep], j[keep], s[keep]


def _least(scores: np.ndarray, wanted: np.ndarray, most: int) -> np.ndarray:
    """What each anchor's last of the first ``most`` has at least; NONE where there are fewer."""
    out = np.full(len(scores), NONE, np.int64)
    for k in np.flatnonzero(wanted.sum(axis=1) >= most):
        out[k] = int(np.sort(scores[k][wanted[k]])[-most])
    return out


def _ranges(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest negative score for each positive score, by whole numbers:
    low * positive <= 100 * negative <= high * positive."""
    low_at = [-((-low * int(p)) // 100) for p in positive]
    return np.array(low_at, np.int64), np.array([(high * int(p)) // 100 for p in positive], np.int64)


def hard_negatives(vectors: DataFrame, anchors: Column | str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = PIVOTS, rows_per_block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors are of whole numbers; a score is the inner product with the anchor, higher
    scores come first, ties by smaller id. ``anchors`` says of ``id`` which rows are
    anchors. An anchor's positives are its first ``positives`` other rows of the same
    label (all, if fewer); for each, its first ``negatives`` rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score.

    Rows without an id, label or vector, with null or non-finite components, and with
    vectors so long that a score might not fit a long (a squared length of 2^62), take no
    part. Rows are rows also where they repeat an id or a vector: a copy is an other row.
    Vectors of different lengths aren't compared. Without anchors, without others of the
    anchor's label, or without negatives in the range, there are no rows; an empty table
    gives none. Other columns are ignored."""
    rows = usable_vectors(vectors, id_col, vector_col, label_col).where("label is not null")
    rows = rows.withColumn("norm", F.expr("aggregate(vector, 0D, (a, x) -> a + x * x)")).where(F.col("norm") < LARGEST)
    parts = [_of_length(rows.where(F.size("vector") == dim), n, anchors, positives, negatives, low, high, pivots, rows_per_block, sample) for dim, n in lengths(rows)]
    if not parts:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _of_length(rows: DataFrame, n: int, anchors, positives: int, negatives: int, low: int, high: int, pivots: int, rows_per_block: int, sample: int) -> DataFrame:
    most = rows.agg(F.max("norm")).first()[0]
    some = drawn(rows, sample, n).select("row", "id", "label", "vector").toArrow()
    if not some.num_rows:  # few rows, none of which was drawn
        some = rows.limit(sample).select("row", "id", "label", "vector").toArrow()
    known = vectors_of(some.column("vector"))
    known_row, known_label = some.column("row").to_numpy(), some.column("label").to_numpy()
    table = Pivots(known, most, pivots)
    blocks = -(-n // rows_per_block)

    def with_pivots(batches):
        for b in batches:
            near = table.of_rows(vectors_of(b.column("vector")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in near], pa.binary())], names=[*b.schema.names, "near"])

    here = F.pmod(F.xxhash64("row"), F.lit(blocks)).alias("block")
    stored = staged(rows.select("row", "id", "label", "vector").mapInArrow(with_pivots, "row long, id long, label long, vector array<double>, near binary").select(here, "*"), "pivots")

    def load(t):
        x = vectors_of(t.column("vector"))
        near = np.frombuffer(b"".join(t.column("near").to_pylist()), np.float64).reshape(len(x), -1)
        label = t.column("label").to_numpy()
        groups = {int(c): np.flatnonzero(label == c) for c in np.unique(label)}
        return x, near, t.column("row").to_numpy(), t.column("id").to_numpy(), label, groups

    def asked(batches):
        """Anchors with what the sample says of their positives."""
        for b in batches:
            q = vectors_of(b.column("vector"))
            wanted = (b.column("label").to_numpy()[:, None] == known_label) & (b.column("row").to_numpy()[:, None] != known_row)
            least = _least(_scores(q, known, most, wanted), wanted, positives)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(least, pa.int64())], names=[*b.schema.names, "least"])

    asking = staged(rows.where(anchors).select("row", "id", "label", "vector").mapInArrow(asked, "row long, id long, label long, vector array<double>, least long"), "anchors")
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")

    def same_label(block, b, at):
        x, near, row, ids, _, groups = block
        q, own, label = vectors_of(b.column("vector")), b.column("row").to_numpy(), b.column("label").to_numpy()
        least = b.column("least").to_numpy()
        near_q = table.of_anchors(q)
        for c in np.unique(label).tolist():
            here, there = np.flatnonzero(label == c), groups.get(c)
            if there is None:
                continue
            _, above = table.brackets(q[here], near_q[here], near[there])
            wanted = (above >= least[here, None]) & (own[here, None] != row[there])
            scores = _scores(q[here], x[there], most, wanted)
            i, j, s = _first(scores, wanted, ids[there], positives)
            if len(i):
                yield packed([own[here]], [at], i, -s, ids[there][j], row[there][j], pa.int64())

    found = meet(stored, asking.select(everywhere, "row", "label", "vector", "least"), load, same_label, packed_schema(1, "long"))
    first = staged(merged(found, ["k0"], blocks, positives).withColumnRenamed("k0", "row"), "positives")

    def bounded(batches):
        """Anchors with the range of each positive, raised by what the sample has in it."""
        for b in batches:
            q = vectors_of(b.column("vector"))
            other = b.column("label").to_numpy()[:, None] != known_label
            scores = _scores(q, known, most, other)
            lows, highs = [], []
            for k, p in enumerate(b.column("positive").to_pylist()):
                a, z = _ranges(np.array(p, np.int64), low, high)
                for m in range(len(a)):
                    in_range = other[k] & (scores[k] >= int(a[m])) & (scores[k] <= int(z[m]))
                    a[m] = max(a[m], _least(scores[k : k + 1], in_range[None], negatives)[0])
                lows.append(a)
                highs.append(z)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lows, pa.list_(pa.int64())), pa.array(highs, pa.list_(pa.int64()))], names=[*b.schema.names, "lows", "highs"])

    scored = asking.drop("least").join(first, "row").withColumn("positive", F.transform("best", lambda x: -x["neg"]))
    ranged = staged(scored.select("row", "label", "vector", "positive").mapInArrow(bounded, "row long, label long, vector array<double>, positive array<long>, lows array<long>, highs array<long>"), "ranges")

    def other_label(block, b, at):
        x, near, row, ids, label, _ = block
        q, own = vectors_of(b.column("vector")), b.column("row").to_numpy()
        lows, highs = b.column("lows").to_pylist(), b.column("highs").to_pylist()
        below, above = table.brackets(q, table.of_anchors(q), near)
        wanted = (b.column("label").to_numpy()[:, None] != label) & (above >= np.array([min(a) for a in lows])[:, None]) & (below <= np.array([max(z) for z in highs])[:, None])
        scores = _scores(q, x, most, wanted)
        for m in range(max(map(len, lows))):
            with_it = np.array([k for k, a in enumerate(lows) if len(a) > m])
            a, z = np.array([lows[k][m] for k in with_it]), np.array([highs[k][m] for k in with_it])
            s = scores[with_it]
            i, j, s = _first(s, wanted[with_it] & (s >= a[:, None]) & (s <= z[:, None]), ids, negatives)
            if len(i):
                yield packed([own[with_it], np.full(len(with_it), m)], [at], i, -s, ids[j], row[j], pa.int64())

    mined = meet(stored, ranged.select(everywhere, "row", "label", "vector", "lows", "highs"), load, other_label, packed_schema(2, "long"))
    hard = merged(mined, ["k0", "k1"], blocks, negatives).select(F.col("k0").alias("row"), F.col("k1").cast("int").alias("nth"), F.posexplode("best").alias("rank", "n"))
    names = asking.select("row", F.col("id").alias("anchor_id")).join(first, "row").select("row", "anchor_id", F.posexplode("best").alias("nth", "p"))
    return hard.join(names, ["row", "nth"]).select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("negative_id"), (-F.col("p.neg")).alias("positive_score"), (-F.col("n.neg")).alias("negative_score"))

"""Near-duplicate vectors: p-stable hashing for Euclidean distance, exact cosines.

Normalised vectors at cosine c are sqrt(2 - 2c) apart. A table's bucket is made of k
quantised projections on Gaussian vectors, floor((a.v + b) / w). The number k follows
the size of the largest label, so that by chance about ``CROWD`` vectors share a
bucket, and the number of tables follows k, so that a pair at the threshold is missed
by all of them with probability ``MISS``.

Vectors meet in buckets in blocks of at most ``ROWS`` rows; a large bucket becomes one
task per pair of its blocks, so none is gathered whole. A pair that meets in several
tables counts in the first one only, which both sides know from all of their buckets.
So counts add up without a list of pairs, and a block passes on a forest of its links
instead of all of them. Equal vectors of one label are one class from the start, which
counts in links as often as it has members.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .components import components

WIDTH, CROWD, MISS, ROWS = 2.0, 64, 1e-4, 512


def agreement(distance: float, width: float = WIDTH) -> float:
    """Probability that two vectors so far apart fall into one cell of a projection."""
    r = width / max(distance, 1e-12)
    return 1 - 2 * NormalDist().cdf(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, least: float, miss: float = MISS) -> tuple[int, int]:
    """Projections per table and tables, for so many vectors of one label."""
    near, far = agreement(math.sqrt(2 - 2 * least)), agreement(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(rows, CROWD) / CROWD) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k))


def _normal(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _stored(x: np.ndarray) -> list[bytes]:
    """Rows of doubles as bytes; as single precision where that says the same."""
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    return [b.tobytes() if same else a.tobytes() for a, b, same in zip(x, short, (short == x).all(axis=1))]


def _restored(rows: list[bytes], dim: int) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in rows])


@lru_cache(maxsize=4)
def _projections(dim: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(11)
    return rng.standard_normal((dim, many)), rng.uniform(0, WIDTH, many)


def _keys(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """Bucket numbers, rows by tables."""
    a, b = _projections(x.shape[1], tables * k)
    cells = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), tables, k)
    h = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(x), tables)).copy()
    for j in range(k):
        h = (h ^ (cells[:, :, j].astype(np.uint64) + np.uint64(0x165667B19E3779F9))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """As few links with the same components."""
    up: dict[int, int] = {}

    def root(x):
        while up.get(x, x) != x:
            up[x] = x = up.get(up[x], up[x])
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = root(x), root(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


_MET = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("other", pa.int64())])


def _meet(least: float):
    def task(key, rows):
        table = key[1].as_py()
        n = rows.num_rows
        order = np.argsort(rows.column("id").to_numpy(), kind="stable")
        rows = rows.combine_chunks().take(pa.array(order))
        ids, part = rows.column("id").to_numpy(), rows.column("part").to_numpy()
        many = rows.column("m").to_numpy()
        x = _normal(_restored(rows.column("vector").to_pylist(), int(key[0].as_py()["label"].split(" ")[0])))
        keys = np.frombuffer(b"".join(rows.column("keys").to_pylist()), np.int64).reshape(n, -1)[:, :table]
        one, two = key[2].as_py(), key[3].as_py()
        left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
        i, j = np.nonzero(x[left] @ x[right].T >= least - 1e-9)
        i, j = left[i], right[j]
        if one == two:
            i, j = i[i < j], j[i < j]
        exact = np.array([float((x[p] * x[q]).sum()) for p, q in zip(i, j)]) if len(i) < 64 else np.einsum("ij,ij->i", x[i], x[j])
        new = (exact >= least) & ~(keys[i] == keys[j]).any(axis=1)
        i, j = i[new], j[new]
        count = np.bincount(np.r_[i, j], np.r_[many[j], many[i]], minlength=n).astype(np.int64)
        some = np.flatnonzero(count)
        links = _forest(ids[i], ids[j])
        out = [ids[some], count[some], np.full(len(some), -1)]
        if links:
            a, b = np.array(links).T
            out = [np.r_[out[0], a], np.r_[out[1], np.zeros(len(a), np.int64)], np.r_[out[2], b]]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out[:2]] + [pa.array(out[2], pa.int64(), mask=np.r_[np.ones(len(some), bool), np.zeros(len(links), bool)])], schema=_MET)

    return task


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", *, least: float = 0.93, miss: float = MISS, rows_per_block: int = ROWS) -> DataFrame:
    """One row per row of ``vectors``: id, n_links, component_id, kept.

    Vectors of one length with equal labels (without ``label_col``, all) and a cosine of ``least`` or
    more, in double precision, are linked; n_links counts other vectors linked
    directly, component_id is the smallest id reachable. Vectors that are null, empty,
    zero, or with null or non-finite components, and rows with a null label or id, are
    linked with nothing. Each row is a vector of its own, also where rows repeat an id.
    Other columns are ignored; an empty table gives no rows."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label_col else F.lit(0)).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = F.expr("size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vector, x -> x != 0)")
    fits = fine & F.col("id").isNotNull() & F.col("label").isNotNull() & v.isNotNull()
    usable = rows.where(fits)
    usable = usable.withColumn("label", F.concat_ws(" ", F.size("vector"), "label"))  # lengths are apart like labels
    usable = usable.withColumns({"h1": F.xxhash64("label", "vector"), "h2": F.xxhash64(F.lit(1), "vector", "label")})
    # equal vectors are one class, known by its smallest id; where that is another class's too, by a hash
    classes = usable.groupBy("h1", "h2", "label").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("m"))
    again = classes.groupBy("rep").agg(F.min(F.struct("h1", "h2")).alias("first"), F.count(F.lit(1)).alias("of")).where("of > 1").select("rep", "first")
    node = F.when(F.coalesce(F.struct("h1", "h2") == F.col("first"), F.lit(True)), F.col("rep")).otherwise(F.col("h1"))
    classes = staged(classes.join(again, "rep", "left").select("h1", "h2", "label", "rep", "m", node.alias("node")), "classes")
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0]
    if most is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    k, tables = plan(most, least, miss)

    def batches(it):
        for batch in it:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                keys = _keys(_normal(x), k, tables)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("m"), part.column("label"), pa.array(_stored(x), pa.binary()), pa.array([r.tobytes() for r in keys], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))],
                    names=["id", "m", "label", "vector", "keys", "buckets"],
                )

    one = usable.select("h1", "h2", F.col("id").alias("rep"), "label", "vector").join(classes.drop("label"), ["h1", "h2", "rep"]).dropDuplicates(["h1", "h2", "rep"])
    hashed = staged(one.select(F.col("node").alias("id"), "m", "label", "vector").mapInArrow(batches, "id long, m long, label string, vector binary, keys binary, buckets array<long>"), "hashed")
    placed = hashed.select("id", "label", F.posexplode("buckets").alias("t", "bucket"))
    crowds = placed.groupBy("label", "t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowds = crowds.withColumn("parts", F.ceil(F.col("n") / rows_per_block).cast("int"))
    full = hashed.select("id", "m", "label", "vector", "keys", F.posexplode("buckets").alias("t", "bucket")).join(crowds, ["label", "t", "bucket"])
    full = full.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    dealt = full.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("id", "m", "vector", "keys", "part", "label", "t", "bucket", F.least("part", "with").alias("one"), F.greatest("part", "with").alias("two"))
    met = staged(dealt.groupBy(F.struct("label", "bucket").alias("where"), "t", "one", "two").applyInArrow(_meet(least), "id long, links long, other long"), "met")
    counts = met.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    label = components(met.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    label = label.join(classes.select(F.col("node").alias("id"), "rep"), "id")
    label = label.join(label.groupBy("component").agg(F.min("rep").alias("first")), "component").select("id", "first")
    known = classes.withColumnRenamed("node", "id").join(counts, "id", "left").join(label, "id", "left")
    known = known.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("first", "rep").alias("component_id"))
    members = usable.select("id", "h1", "h2").join(known, ["h1", "h2"]).select("id", "n_links", "component_id")
    zero = F.lit(0).cast("long").alias("n_links")
    others = rows.where(~F.coalesce(fits, F.lit(False))).select("id", zero, F.col("id").alias("component_id"))
    out = members.union(others).withColumnRenamed("id", id_col)
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))

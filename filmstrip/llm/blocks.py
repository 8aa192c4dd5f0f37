"""Searches of a stated set of queries against all rows, a block of rows at a time.

Rows are dealt to blocks of a bounded size. A task holds one block and its queries
stream past it, so no group is ever gathered whole, on either side. What a query finds
in a block is a short list, and lists of one query are merged by a tree of bounded fan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Queries of a block that are looked at at once, lists that one merge takes.
AT_ONCE, FAN = 128, 64


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str | None = None) -> DataFrame:
    """row (a key for the job), id, label (null without ``label_col``), vector: rows with
    an id and a vector whose components are all there and finite. Other columns are left
    out, so their names can't clash."""
    label = F.col(label_col) if label_col else F.lit(None)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    fine = rows.where("id is not null and vector is not null and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return staged(fine.withColumn("row", F.monotonically_increasing_id()), "vectors")


def lengths(rows: DataFrame) -> list[tuple[int, int]]:
    """Each length of vectors, and how many have it. Vectors of different lengths aren't
    compared; lengths are taken to be few."""
    return [(r[0], r[1]) for r in rows.groupBy(F.size("vector")).count().orderBy(F.size("vector")).collect()]


def drawn(rows: DataFrame, many: int, of: int) -> DataFrame:
    """About ``many`` of ``of`` rows, by a hash of their keys: never more than twice as many."""
    share = min(1.0, many / max(of, 1))
    part = F.pmod(F.xxhash64("row", F.lit(23)), F.lit(1 << 30))
    return rows.where(part < int(share * (1 << 30))).orderBy(part).limit(2 * many)


def vectors_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of vectors of one length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), len(flat) // max(len(column), 1))


def best(q: np.ndarray, neg: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Indices of the first ``most`` pairs of each q, by neg, then id, in that order."""
    order = np.lexsort((ids, neg, q))
    q = q[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    nth = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return order[nth < most]


def packed(owner: list, slots: list[int], q: np.ndarray, neg: np.ndarray, ids: np.ndarray, rows: np.ndarray, kind: pa.DataType) -> pa.RecordBatch:
    """One row per query that found something: its key, a slot, and its list. Pairs are
    ordered by q; owner has the key columns' values by q."""
    found, start = np.unique(q, return_index=True)
    list_of = pa.StructArray.from_arrays([pa.array(neg, kind), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())], names=["neg", "id", "row"])
    offsets = pa.array(np.r_[start, len(q)], pa.int32())
    columns = [pa.array(np.asarray(c)[found], pa.int64()) for c in owner]
    names = [f"k{i}" for i in range(len(owner))]
    return pa.RecordBatch.from_arrays([*columns, pa.array([slots[0]] * len(found), pa.int64()), pa.ListArray.from_arrays(offsets, list_of)], names=[*names, "slot", "best"])


def packed_schema(keys: int, kind: str) -> str:
    return ", ".join(f"k{i} long" for i in range(keys)) + f", slot long, best array<struct<neg: {kind}, id: long, row: long>>"


def meet(rows: DataFrame, queries: DataFrame, load, task, schema: str) -> DataFrame:
    """What ``task(load(block), queries, block number)`` yields, over all blocks. Both
    tables have a column ``block``; a block's rows come as one Arrow table, its queries
    in batches of at most ``AT_ONCE``."""
    cols = lambda df: [c for c in df.columns if c != "block"]
    r, q = F.struct(*cols(rows)), F.struct(*cols(queries))
    kinds = [dict(df.select(s.alias("s")).dtypes)["s"] for df, s in ((rows, r), (queries, q))]
    both = rows.select("block", F.lit(0).alias("side"), r.alias("r"), F.lit(None).cast(kinds[1]).alias("q")).union(queries.select("block", F.lit(1), F.lit(None).cast(kinds[0]), q))

    def stream(batches):
        at, held, ready = None, [], None
        for batch in batches:
            block, side = batch.column("block").to_numpy(), batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(block) != 0) | (np.diff(side) != 0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if block[a] != at:
                    at, held, ready = block[a], [], None
                if side[a] == 0:
                    held.append(pa.RecordBatch.from_struct_array(batch.column("r").slice(a, b - a)))
                    continue
                if held and ready is None:
                    ready = load(pa.Table.from_batches(held).combine_chunks())
                if ready is not None:
                    for i in range(a, b, AT_ONCE):
                        asked = pa.RecordBatch.from_struct_array(batch.column("q").slice(i, min(b, i + AT_ONCE) - i))
                        yield from task(ready, asked, int(at))

    return both.repartition("block").sortWithinPartitions("block", "side").mapInArrow(stream, schema)


def merged(partial: DataFrame, keys: list[str], slots: int, most: int) -> DataFrame:
    """keys, best: of each key the first ``most`` found, each once, over all its slots
    (0 to ``slots`` - 1), by neg, then id."""
    short = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, most)
    while True:
        slots = -(-slots // FAN)
        if slots <= 1:
            return partial.groupBy(*keys).agg(short.alias("best"))
        partial = partial.groupBy(*keys, F.floor(F.col("slot") / FAN).alias("slot")).agg(short.alias("best"))

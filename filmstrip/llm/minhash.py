"""Near-duplicate documents: HyperMinHash registers, banding, estimate, verification.

Every document's set of word shingles is hashed once into ``BUCKETS`` buckets. Of
each bucket's smallest value the register keeps the count of leading zeros and
``MANTISSA`` bits behind the leading one (HyperMinHash). ``ROWS`` registers in a row
make a band; documents that agree in a band are candidates. Agreeing registers,
less the agreement by chance expected at the two set sizes, estimate the Jaccard
similarity, and candidates well below the threshold go. What is left is compared
on full sets of 64-bit shingle hashes.

At a similarity of 0.8 a band of 6 agrees with probability 0.26, so all 40 miss with
probability 5e-6; above, less. Equal sets are one class from the start and their
members are never compared.

Links only have to hold components together. So each member of a band is first compared
with one leader, the band's smallest id. What is then still split goes through two exact
filters instead of comparing members with each other:

* A document goes if more of its set than the threshold allows is in no other document
  that is still in question.
* Bands of the documents left get one leader each, by a hash of the id, so that bands
  of one group of copies share leaders. Let U be what a member's set has over its
  leader's. A member outside the leader's component has more in U than a link with the
  leader allows, so to be linked with any other member it must share so many elements of
  U with it (fewer, if that one is smaller than the leader; sizes that allow none are
  compared as they are). What all copies have in common cancels out, and what is left is
  joined by its rarest elements first (prefix filter).

So no link between components is lost, and a large group of copies that differ from one
text here and there costs about as many comparisons as it has members. That isn't so for
texts of a form whose many places take a few common values each: most elements over a
leader are then common ones, and most pairs of the form's texts are estimated, and those
near the threshold compared.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan
from .common import held, sized, slices, staged
from .components import components

ROWS, BANDS, MANTISSA = 6, 40, 10
BUCKETS = ROWS * BANDS
#: Standard errors that an estimate may lie under the threshold.
SLACK = 4.5
_EMPTY = np.uint16(0xFFFF)


def registers(u: np.ndarray) -> np.ndarray:
    """The registers of a sorted set of hashes: bucket by the upper half, value by
    a further mix of the whole."""
    out = np.full(BUCKETS, _EMPTY, np.uint16)
    bucket = ((u >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    value = scan.mix(u ^ np.uint64(0xA24BAED4963EE407))
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    least = np.minimum.reduceat(value, first)
    high = (least >> np.uint64(12)).astype(np.float64)  # 52 bits, exactly
    exponent = np.frexp(high)[1]  # the leading one's place, 0 if there is none
    zeros = 52 - exponent
    tail = np.where(exponent > MANTISSA, (least >> np.uint64(12)) >> np.maximum(exponent - 1 - MANTISSA, 0).astype(np.uint64), least) & np.uint64((1 << MANTISSA) - 1)
    out[bucket[first].astype(np.int64)] = (zeros.astype(np.uint64) << np.uint64(MANTISSA) | tail).astype(np.uint16)
    return out


_DONORS = np.random.default_rng(7).permuted(np.tile(np.arange(BUCKETS, dtype=np.uint8), (BUCKETS, 1)), axis=1)


def _bands(regs: np.ndarray) -> np.ndarray:
    """One hash per band. Here an empty register borrows from the filled one that
    comes first in its own random order of buckets, so that a small set's bands agree
    as rarely as a large one's."""
    filled = np.flatnonzero(regs != _EMPTY)
    empty = np.flatnonzero(regs == _EMPTY)
    if len(empty):
        regs = regs.copy()
        regs[empty] = regs[filled[_DONORS[empty[:, None], filled].argmin(axis=1)]]
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = regs.reshape(BANDS, ROWS)
    for j in range(ROWS):
        h = scan.mix(h + rows[:, j])
    return h


def _key(u: np.ndarray) -> bytes:
    """128 bits of a whole set."""
    return np.array([u.sum(dtype=np.uint64), scan.mix(u).sum(dtype=np.uint64)], np.uint64).tobytes()


def signatures(docs: DataFrame, id_col: str, text_col: str, word: np.ndarray, width: int, carry: Sequence[str] = ()) -> DataFrame:
    """Per document: the carried columns, id, n (set size), key (128 bits of the whole
    set), regs, bands. Null and wordless texts have n 0 and nothing else."""
    kinds = dict(docs.dtypes)

    def batches(it):
        held()
        for batch in slices(it, "text"):
            h, begin = scan.words(batch.column("text"), word)
            n, keys, regs, bands = [], [], [], []
            for a, b in zip(begin, begin[1:]):
                u = np.unique(scan.shingle_hashes(h[a:b], width))
                n.append(len(u))
                if len(u):
                    keys.append(_key(u))
                    r = registers(u)
                    regs.append(r.tobytes())
                    bands.append(_bands(r).view(np.int64))
                else:
                    keys.append(None)
                    regs.append(None)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=[*carry, "id", "n", "key", "regs", "bands"],
            )

    ddl = "".join(f"`{c}` {kinds[c]}, " for c in carry) + "id long, n long, key binary, regs binary, bands array<long>"
    return docs.select(*carry, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(batches, ddl)


def _sets(docs: DataFrame, word: np.ndarray, width: int) -> DataFrame:
    """Of rows of id, key and text those whose set has that key, with the whole set,
    sorted, eight bytes a hash."""

    def batches(it):
        for batch in slices(it, "text"):
            h, begin = scan.words(batch.column("text"), word)
            sets = [np.unique(scan.shingle_hashes(h[a:b], width)) for a, b in zip(begin, begin[1:])]
            right = pa.array([_key(u) == k for u, k in zip(sets, batch.column("key").to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([u.tobytes() for u in sets], pa.binary())], names=["id", "hashes"]).filter(right)

    return docs.select("id", "key", "text").mapInArrow(batches, "id long, hashes binary")


def by_chance(n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Probability that the registers of two disjoint sets agree in a bucket that
    both fill: the sum over leading zeros of both minima lying in one cell, the
    mantissa being even within it."""
    low = 0.5 ** np.arange(1, 33)
    fill = lambda n: (1 - low) ** (n[:, None] / BUCKETS) - (1 - 2 * low) ** (n[:, None] / BUCKETS)
    full = lambda n: np.maximum(1 - np.exp(-n / BUCKETS), 1e-12)
    return (fill(n_a) * fill(n_b)).sum(axis=1) / (full(n_a) * full(n_b)) * 0.5**MANTISSA


def estimate(regs_a: np.ndarray, regs_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of rows of registers, and over how many
    buckets."""
    some = (regs_a != _EMPTY) | (regs_b != _EMPTY)
    same = ((regs_a == regs_b) & some).sum(axis=1)
    buckets = np.maximum(some.sum(axis=1), 1)
    chance = by_chance(n_a.astype(float), n_b.astype(float)) * buckets
    return np.clip((same - chance) / np.maximum(buckets - chance, 1e-9), 0, 1), buckets


def _promising(pairs: DataFrame, sigs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose sizes allow the similarity and whose estimate
    isn't far below it."""
    side = lambda c: sigs.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"regs_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.expr(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)"))
    least = percent / 100

    def batches(it):
        for batch in it:
            regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("regs_a", "regs_b")]
            n = [batch.column(c).to_numpy() for c in ("n_a", "n_b")]
            if batch.num_rows:
                j, m = estimate(*regs, *n)
                keep = j + SLACK * math.sqrt(least * (1 - least)) / np.sqrt(m) + 1e-9 >= least
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return both.select("a", "b", "n_a", "n_b", "regs_a", "regs_b").mapInArrow(batches, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union, on full sets."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"set_{c}"))

    def batches(it):
        for batch in it:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([u, v]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(u) + len(v) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b").mapInArrow(batches, "a long, b long")


def _hopeless(ids: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``ids`` those that can't be linked with any other of them: of their sets, more
    than a similarity of ``percent`` allows is in no other one's."""

    def batches(it):
        for batch in it:
            sizes = [len(x.as_py()) // 8 for x in batch.column("hashes")]
            h = np.frombuffer(b"".join(batch.column("hashes").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), sizes)), pa.array(h)], names=["id", "h"])

    some = sets.join(ids, "id", "left_semi")
    each = some.select("id", "hashes").mapInArrow(batches, "id long, h long")
    alone = each.groupBy("h").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("id")).where("m = 1")
    alone = alone.groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    return some.select("id", (F.octet_length("hashes") / 8).alias("n")).join(alone, "id").where(f"100 * (n - alone) < {percent} * n").select("id")


def _over(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of (leader, id) pairs: whether they are linked, the sizes of both sets, and what
    the id's set has over the leader's."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"set_{c}"))

    def batches(it):
        for batch in it:
            linked, sizes, more, of = [], [], [], []
            for x, y in zip(batch.column("set_leader"), batch.column("set_id")):
                u, v = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                new = np.setdiff1d(v, u, assume_unique=True)
                common = len(v) - len(new)
                linked.append(100 * common >= percent * (len(u) + len(v) - common))
                sizes.append(len(v))
                of.append(len(u))
                more.append(new)
            yield pa.RecordBatch.from_arrays(
                [batch.column("leader"), batch.column("id"), pa.array(linked, pa.bool_()), pa.array(sizes, pa.int64()), pa.array(of, pa.int64()), pa.array(more, pa.list_(pa.int64()))],
                names=["leader", "id", "linked", "n", "of", "more"],
            )

    return groups.join(side("leader"), "leader").join(side("id"), "id").select("leader", "id", "set_leader", "set_id").mapInArrow(batches, "leader long, id long, linked boolean, n long, of long, more array<long>")


def _across(over: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of one leader, in different components, that may be
    linked: all those that are, by what each has over the leader (see above)."""
    part = label.select("id", "component")
    lead = over.select("leader").distinct().join(part.withColumnRenamed("id", "leader"), "leader", "left").select("leader", F.coalesce("component", "leader").alias("main"))
    rows = over.join(lead, "leader").join(part, "id", "left").withColumn("c", F.coalesce("component", "id"))
    # shared elements that a link with a set of m elements takes: need + share * (m - of)
    share = percent / (100 + percent)
    need = F.size("more") - F.col("n") + share * (F.col("n") + F.col("of"))
    rows = rows.select("leader", "id", "n", "of", "c", (F.col("c") != F.col("main")).alias("far"), need.alias("need"), "more")
    rows = sized(staged(rows.where("id != leader"), "over"))[0]
    each = rows.select("leader", "id", "c", F.explode("more").alias("x"))
    useful = each.groupBy("leader", "x").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 != c2").select("leader", "x", "m")
    ranks = Window.partitionBy("leader", "id")
    each = each.join(useful, ["leader", "x"]).withColumn("rank", F.row_number().over(ranks.orderBy("m", "x"))).withColumn("use", F.count(F.lit(1)).over(ranks))
    info = rows.select("leader", "id", "n", "of", "far", "need")
    each = staged(each.select("leader", "id", "c", "x", "rank", "use").join(info, ["leader", "id"]).where("far or use > 0"), "elements")
    # a far member's rarest elements that a link can do without, at the smallest size it can be linked with
    least = F.greatest(F.col("need") + share * (F.ceil(F.col("n") * percent / 100) - F.col("of")) - 1e-6, F.lit(0))
    probe = each.where("far").where(F.col("rank") <= F.col("use") - F.greatest(F.ceil(least), F.lit(1)) + 1)
    i = lambda d, s, *more: d.select("leader", *more, *(F.col(c).alias(f"{c}_{s}") for c in ("id", "c", "n", "of", "far", "need")))
    fits = F.expr(f"c_i != c_j and (not far_j or id_j < id_i) and 100 * least(n_i, n_j) >= {percent} * greatest(n_i, n_j)")
    must = lambda a, b: F.greatest(F.ceil(F.col(f"need_{a}") + share * (F.col(f"n_{b}") - F.col(f"of_{a}")) - 1e-6), F.lit(1))
    found = i(probe, "i", "x", F.col("rank").alias("r_i"), F.col("use").alias("u_i")).join(i(each, "j", "x", F.col("rank").alias("r_j"), F.col("use").alias("u_j")), ["leader", "x"])
    both = F.greatest(must("i", "j"), must("j", "i"))
    found = found.where(fits & (F.col("r_i") <= F.col("u_i") - both + 1) & (F.col("r_j") <= F.col("u_j") - both + 1))
    # members so much smaller than the leader that they need nothing in common over it
    low, high = F.ceil(F.col("n") * percent / 100), F.floor(F.col("of") - F.col("need") / share + 1e-6)
    small = i(rows.where("far").where(high >= low).withColumn("size", F.explode(F.sequence(low, high))), "i", "size")
    small = small.join(i(rows, "j", F.col("n").alias("size")), ["leader", "size"]).where(fits)
    pairs = found.select("id_i", "id_j").union(small.select("id_i", "id_j"))
    return pairs.select(F.least("id_i", "id_j").alias("a"), F.greatest("id_i", "id_j").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 5, percent: int = 80, word: np.ndarray = scan.NOT_SPACE, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: the columns to ``carry``, id, n_shingles,
    component_id, kept, group_id (a number that the rows of one group share, null for
    rows that can't be linked).

    A document's set holds its distinct runs of ``width`` lower-cased words; with
    fewer words the whole sequence is the one element. Documents with
    100 * |A and B| >= percent * |A or B| are linked; component_id is the smallest
    id reachable, kept is id = component_id. Null, empty and wordless texts have
    n_shingles 0 and are linked with nothing. Rows with a null id have a null
    component and are kept. Each row is a document of its own, also where rows repeat
    an id. Other columns are ignored; an empty table gives no rows."""
    sigs = staged(signatures(docs, id_col, text_col, word, width, carry), "sigs")
    # equal sets are one class, known by its smallest id; where that is another class's too, by a hash
    classes = sigs.where("n > 0 and id is not null").groupBy("key").agg(F.min("id").alias("rep"))
    again = classes.groupBy("rep").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").select("rep", "first")
    node = F.when(F.coalesce(F.col("key") == F.col("first"), F.lit(True)), F.col("rep")).otherwise(F.xxhash64("key"))
    classes = staged(classes.join(again, "rep", "left").select("key", "rep", node.alias("node")), "classes")
    reps = sigs.select("id", "n", "key", "regs", "bands").join(classes.select(F.col("rep").alias("id"), "key", "node"), ["id", "key"]).dropDuplicates(["id", "key"])
    reps = staged(reps.select(F.col("node").alias("id"), F.col("id").alias("rep"), "n", "regs", "bands"), "reps")

    bands = reps.select("id", "rep", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("rep", "id")).alias("leader")).where("m > 1").select("band", F.col("leader.id").alias("leader"))
    bands = staged(bands.join(shared, "band").select("band", "id", "leader"), "bands")

    wanted = classes.join(bands.select(F.col("id").alias("node")).distinct(), "node", "left_semi")
    needed = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")).join(wanted, "rep")
    needed = needed.withColumn("t", F.xxhash64("text")).dropDuplicates(["rep", "key", "t"])
    sets = staged(_sets(needed.select(F.col("node").alias("id"), "key", "text"), word, width), "sets")

    pairs = bands.where("id != leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    links = staged(verified(_promising(sized(staged(pairs, "pairs"))[0], reps, percent), sets, percent), "links")
    label = components(links)

    def split(bands: DataFrame) -> DataFrame:
        """The bands that still join different components."""
        now = bands.select("band", "id").join(label, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
        mixed = now.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.min(F.struct(F.xxhash64("id").alias("h"), "id")).alias("leader"))
        return sized(staged(mixed.where("c1 != c2").select("band", F.col("leader.id").alias("leader")), "mixed"))[0]

    mixed = split(bands)
    if not mixed.isEmpty():
        open_ = bands.join(mixed.select("band"), "band").select("id").distinct()
        bands = staged(bands.join(_hopeless(open_, sets, percent), "id", "left_anti").select("band", "id"), "bands")
        groups = bands.join(split(bands), "band").select("leader", "id").distinct()
        over = staged(_over(sized(staged(groups, "groups"))[0], sets, percent), "over")
        found = over.where("linked and leader != id").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b"))
        if not found.isEmpty():
            links = links.union(found)
            label = components(links)
        pairs = sized(staged(_across(over, label, percent), "pairs"))[0]
        found = staged(verified(_promising(pairs, reps, percent), sets, percent), "links")
        if not found.isEmpty():
            label = components(links.union(found))

    members = sigs.select(*carry, "id", "n", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(classes, "key", "left")  # node is null without a key
    of = label.join(classes.select(F.col("node").alias("id"), "rep"), "id")
    of = of.join(of.groupBy("component").agg(F.min("rep").alias("least")), "component").select(F.col("id").alias("node"), "component", "least")
    out = members.join(of, "node", "left")
    out = out.select(*carry, F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "rep", "id").alias("component_id"), F.coalesce("component", "node").alias("group_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))

"""Benchmark decontamination: CGK random-walk embedding, bit sampling, exact edits.

Texts are words (ASCII lower case, letters, digits and all beyond ASCII). A benchmark
item is looked for with at most 0.2 edits per word of it, in windows of its own size.

The CGK embedding walks over a window's words: at each step it writes the word it
stands on, and a random bit of that word and step says whether it goes on to the next.
Walks over two texts that differ by few edits fall into step again soon after each, so
few of the written places differ: edit distance has become Hamming distance. Sampling a
few of these places, a number of times for each of a number of walks, gives keys, and
windows that share a key with an item are candidates. How many walks a size class of
items gets follows from the recall wanted (``RECALL``), measured on planted items at the
full number of edits.

Windows are embedded at every word from which a window of an item's size, edits
included, shares enough word pairs with the benchmark (the q-gram lemma: an edit spoils
two pairs at most, so this loses nothing). Candidates are verified by exact edit distance.
"""

from __future__ import annotations

import warnings
from collections import defaultdict
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import held, slices

#: Words of the shortest item.
SHORTEST = 3
SHARE = 0.2
#: Share of occurrences at the full number of edits that the keys are to find, the
#: planted items that it is measured on, and the most walks.
RECALL, PLANTED, WALKS = 0.999, 2000, 96
#: Samples of a walk.
SAMPLES = 8
#: Items that one pass carries to the tasks, and their bytes; more go in more passes.
PASS_ITEMS, PASS_BYTES = 200_000, 64 << 20
#: Windows that are embedded in one step.
STEP = 1 << 18


def edit_distance(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(distance, begin, end) of the run of ``words`` nearest to ``item``: as few edits
    as possible, then the first end, then the longest such run."""
    n = len(words)
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    span = np.arange(n + 1)
    for i, x in enumerate(item, 1):
        change = row[:-1] + (words != x)
        drop = row[1:] + 1
        new, new_begin = np.empty(n + 1, np.int64), np.empty(n + 1, np.int64)
        new[0], new_begin[0] = i, 0
        new[1:] = np.minimum(change, drop)
        new_begin[1:] = np.where(change <= drop, begin[:-1], begin[1:])
        low = np.minimum.accumulate(new - span)  # inserted words
        source = np.maximum.accumulate(np.where(new - span == low, span, 0))
        row, begin = low + span, new_begin[source]
    end = int(row.argmin())
    return int(row[end]), int(begin[end]), end


def edits(n: int) -> int:
    """Edits that an item of ``n`` words may have."""
    return int(SHARE * n + 1e-9)


def size_class(n: int) -> int:
    """The smallest size in an item's class; a class spans a fifth of that."""
    low = SHORTEST
    while low + max(1, low // 5) <= n:
        low += max(1, low // 5)
    return low


def _steps(low: int) -> int:
    """Steps of the walks of a class: about as many as keep within its items."""
    return int(1.6 * low) + 2


@lru_cache(maxsize=None)
def _walk_plan(low: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """A multiplier per step, and the places that each sample takes."""
    r = np.random.default_rng((17, low, walk))
    taken = 3 if low >= 8 else 2
    places = np.stack([np.sort(r.choice(_steps(low), taken, replace=False)) for _ in range(SAMPLES)])
    return r.integers(0, 1 << 63, _steps(low), dtype=np.uint64) * np.uint64(2) + np.uint64(1), places


#: Words that stand before a row for windows that begin there, the last one first.
_BEFORE = scan.mix(np.arange(1, 1 << 12, dtype=np.uint64))


def keys(h: np.ndarray, start: np.ndarray, begin: np.ndarray, end: np.ndarray, low: int, walk: int) -> np.ndarray:
    """Keys of one walk, samples by windows: those from ``start`` on over the words
    ``h`` of rows that begin and end so (nothing follows an end)."""
    turns, places = _walk_plan(low, walk)
    wanted, written = set(places.ravel().tolist()), {}
    i, last = start.copy(), max(len(h) - 1, 0)
    for j in range(max(wanted) + 1):
        w = np.where(i < end, h[np.clip(i, 0, last)], np.uint64(0))
        early = np.flatnonzero(i < begin)
        if len(early):
            w[early] = _BEFORE[(begin - i)[early] % len(_BEFORE)]
        if j in wanted:
            written[j] = w
        i += (w * turns[j] >> np.uint64(63)).astype(np.int64)
    out = np.empty((SAMPLES, len(start)), np.uint64)
    for t, row in enumerate(places.tolist()):
        k = np.full(len(start), (walk * SAMPLES + t + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for j in row:
            k = scan.mix(k + written[j])
        out[t] = k
    return out


def planted(n: int, trials: int, rng: np.random.Generator, where: slice = slice(None)) -> tuple[np.ndarray, list[np.ndarray]]:
    """Items of ``n`` different words, and each with all the edits it may have (words
    put in, left out and replaced, anywhere or ``where`` says) among others."""
    items = rng.integers(1, 1 << 63, (trials, n), dtype=np.uint64)
    texts = []
    for item in items:
        w = item.tolist()
        for at in sorted(rng.choice(np.arange(n)[where], edits(n), replace=False).tolist(), reverse=True):
            new = int(rng.integers(1, 1 << 63))
            w[at : at + 1] = [[], [new], [new, w[at]]][rng.integers(3)]
        around = rng.integers(1, 1 << 63, 2 * n, dtype=np.uint64)
        texts.append(np.concatenate([around[:n], np.array(w, np.uint64), around[n:]]))
    return items, texts


@lru_cache(maxsize=None)
def walks(low: int, recall: float = RECALL) -> int:
    """Walks with which the keys of a class find this share of its planted items, by
    the size that may have most edits a word."""
    n = max(range(low, low + max(1, low // 5)), key=lambda n: (edits(n) / n, -n))
    items, texts = planted(n, PLANTED, np.random.default_rng((19, low)))
    k = edits(n)
    starts = np.arange(n - k, n + k + 1)
    base = np.cumsum([0] + [len(t) for t in texts])
    start, end = (base[:-1, None] + starts).ravel(), np.repeat(base[1:], len(starts))
    flat, h = items.ravel(), np.concatenate(texts)
    found = np.zeros(len(items), bool)
    for walk in range(WALKS):
        at = np.arange(len(items)) * n
        mine = keys(flat, at, at, at + n, low, walk)
        theirs = keys(h, start, start, end, low, walk).reshape(SAMPLES, len(items), -1)
        found |= (mine[:, :, None] == theirs).any(axis=(0, 2))
        if found.mean() >= recall:
            return walk + 1
    warnings.warn(f"items of {low} words: {WALKS} walks find {found.mean():.4f} of the planted ones, {recall} were asked for", RuntimeWarning, stacklevel=2)
    return WALKS


def _longer(runs: np.ndarray, h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words, from those of the runs one word shorter."""
    return scan.mix(runs[: len(h) - width + 1] * np.uint64(0xD6E8FEB86659FD93) + h[width - 1 :])


class _Keys:
    """Sorted hashes, and which of many others are among them."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.unique(hashes)
        self.quick = np.zeros(1 << 22, bool)
        self.quick[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``h``, number of the key) of those found."""
        at = np.flatnonzero(self.quick[(h >> np.uint64(42)).astype(np.int64)])
        n = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        same = self.keys[n] == h[at]
        return at[same], n[same]


class _Index:
    """Items, their word pairs and, by size class, their keys."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.words = [scan.word_hash(t or "", scan.ALNUM) for _, t in items]
        self.lists = [w.tolist() for w in self.words]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.most = np.array([edits(n) for n in self.sizes.tolist()], np.int64)
        by = defaultdict(list)
        for k, n in enumerate(self.sizes.tolist()):
            if n >= SHORTEST:
                by[size_class(n)].append(k)
        self.classes = [self._class(low, np.array(members)) for low, members in sorted(by.items())]
        if by:
            members = [k for m in by.values() for k in m]
            self.pairs = _Keys(np.concatenate([_longer(self.words[k], self.words[k], 2) for k in members]))

    def _class(self, low: int, members: np.ndarray):
        """(class, walks, words of its widest window, least word pairs in one, keys, and
        the items of each key)."""
        n, most = self.sizes[members], self.most[members]
        h = np.concatenate([self.words[k] for k in members])
        base = np.cumsum(np.r_[0, n])
        found = np.concatenate([keys(h, base[:-1], base[:-1], base[1:], low, w).ravel() for w in range(walks(low))])
        item = np.tile(members, len(found) // len(members))
        order = np.argsort(found, kind="stable")
        table = _Keys(found)
        return low, walks(low), int((n + most).max()), int((n - 1 - 2 * most).min()), table, np.r_[np.searchsorted(found[order], table.keys), len(found)], item[order]

    def candidates(self, h: np.ndarray, begin: np.ndarray):
        """Arrays of row, item and first word of windows that share a key with the item
        and enough word pairs with the benchmark; they can come repeatedly."""
        if not self.classes or len(h) < 2:
            return
        hit = np.zeros(len(h), bool)
        hit[self.pairs.find(_longer(h, h, 2))[0]] = True
        inner = begin[1:-1]
        hit[inner[(inner > 0) & (inner < len(h))] - 1] = False  # pairs across rows
        sums = np.r_[0, np.cumsum(hit)]
        for low, many, wide, least, table, first, items in self.classes:
            behind = np.minimum(np.arange(len(h)) + wide - 1, len(h))
            at = np.flatnonzero(sums[behind] - sums[:-1] >= least)
            at, row = [at], [np.searchsorted(begin, at, "right") - 1]
            for early in range(1, edits(wide) + 1):  # an item's first words may be missing at a row's begin
                some = np.flatnonzero(sums[np.minimum(np.maximum(begin[:-1] - early + wide - 1, begin[:-1]), len(h))] - sums[begin[:-1]] >= least)
                at.append(begin[some] - early)
                row.append(some)
            at, row = np.concatenate(at), np.concatenate(row)
            for a in range(0, len(at), STEP):
                s, r = at[a : a + STEP], row[a : a + STEP]
                for walk in range(many):
                    for k in keys(h, s, begin[r], begin[r + 1], low, walk):
                        i, n = table.find(k)
                        each = first[n + 1] - first[n]
                        j = np.arange(each.sum()) + np.repeat(first[n] - np.cumsum(each) + each, each)
                        k, s1, r1 = items[j], np.repeat(s[i], each), np.repeat(r[i], each)
                        high = np.minimum(s1 + self.sizes[k] + self.most[k], begin[r1 + 1])
                        from_ = np.maximum(s1 - self.most[k], begin[r1])
                        enough = sums[np.maximum(high - 1, 0)] - sums[from_] >= self.sizes[k] - 1 - 2 * self.most[k]
                        yield r1[enough], k[enough], s1[enough]

    def hits(self, h: np.ndarray, begin: np.ndarray):
        """(row, item, first word, words, distance), the nearest place of each item in
        each row, verified."""
        by: dict[tuple[int, int], list[int]] = defaultdict(list)
        lists = self.lists
        for row, k, s in {c for found in self.candidates(h, begin) for c in zip(*(x.tolist() for x in found))}:
            by[row, k].append(s)
        for (row, k), places in sorted(by.items()):
            item = self.words[k]
            n, most = len(item), edits(len(item))
            best, reach = None, -n
            for s in sorted(places):
                if s <= reach:
                    continue
                reach = s + most
                low, high = max(int(begin[row]), s - most), min(int(begin[row + 1]), s + 2 * most + n)
                if high <= low:
                    continue
                near = set(h[low:high].tolist())
                if sum(w in near for w in lists[k]) < n - most:  # each word that isn't there is an edit
                    continue
                d, a, b = edit_distance(item, h[low:high])
                if d <= most and (best is None or d < best[0]):
                    best = (d, low + a - int(begin[row]), b - a)
            if best:
                yield row, self.ids[k], best[1], best[2], best[0]


def _index(items: tuple) -> _Index:
    """A worker keeps the index of the pass it is in."""
    indexes = held("decontamination")
    if items not in indexes:
        indexes.clear()
        indexes[items] = _Index(list(items))
    return indexes[items]


FOUND = pa.schema([("id", pa.int64()), ("item", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int64())])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *, carry: Sequence[str] = ()) -> DataFrame:
    """One row per document and benchmark item found in it: the columns to ``carry``,
    id, item, first_word, n_words, distance (edits in words, at most 0.2 per word of the
    item), of the nearest place, ties going to the first.

    Null and empty texts and items, and items under three words, are never found; items
    of three and four words have no edits. Repeated documents have rows each; equal
    benchmark rows count once. Items with a null id are ignored. Other columns are
    ignored. The benchmark goes to the tasks in passes of a bounded size, with a scan of
    ``docs`` each."""
    wanted = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).alias("text")).distinct()
    count, size = wanted.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    passes = max(1, -(-count // PASS_ITEMS), -(-(size or 0) // PASS_BYTES))
    kinds = dict(docs.dtypes)
    rows = docs.select(*carry, F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    ddl = "".join(f"`{c}` {kinds[c]}, " for c in carry) + "id long, item long, first_word long, n_words long, distance long"
    out = None
    for n in range(passes):
        items = [tuple(r) for r in (wanted if passes == 1 else wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == n)).collect()]

        def batches(it, items=tuple(sorted(items))):
            index = _index(items)
            for batch in slices(it, "text"):
                h, begin = scan.words(batch.column("text"), scan.ALNUM)
                found = list(index.hits(h, begin)) if batch.num_rows else []
                row = pa.array([f[0] for f in found], pa.int64())
                cols = [pa.array([f[j] for f in found], pa.int64()) for j in range(1, 5)]
                yield pa.RecordBatch.from_arrays([c.take(row) for c in batch.columns[:-1]] + cols, names=[*carry, *FOUND.names])

        part = rows.mapInArrow(batches, ddl)
        out = part if out is None else out.union(part)
    return out.select(*carry, F.col("id").alias(id_col), F.col("item").alias("item_id"), "first_word", "n_words", "distance")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item; rows that repeat an id
    or have none are told apart by their texts."""
    marked = docs.withColumn("_text", F.xxhash64(text_col))
    found = contaminated(marked, benchmark, id_col, text_col, carry=["_text"], **columns).select(F.col(id_col).alias("_id"), F.col("_text").alias("_of")).distinct()
    return marked.join(found, (F.col(id_col).cast("long").eqNullSafe(F.col("_id"))) & (F.col("_text") == F.col("_of")), "left_anti").drop("_text")

"""Removal of repeated passages: longest previous factors over shared contexts.

A byte goes if a string of ``WINDOW`` bytes over it also starts in a document with a
smaller id. In suffix order, the longest earlier match of a suffix is at the nearest
suffix before or after it that has a smaller document (previous and next smaller
values); the longest previous factor then decides. No machine holds a suffix array of
the whole corpus; it is built in parts that can't miss a match:

1. Documents are dealt into blocks of about ``BLOCK`` bytes. In every string of WINDOW
   bytes the smallest hash of a run of ``GRAM`` bytes (its rightmost place, or all of
   them if equal) is an anchor. Equal strings have equal anchors.
2. Blocks send only their anchors' hashes, sorted and as differences, to buckets of
   hash ranges, narrower ones for small hashes, which most anchors have. A bucket tells each block which of its anchors other blocks have too.
3. For anchors in two or more documents blocks send contexts: all bytes that a string
   of WINDOW bytes around the anchor can hold. Equal contexts of a block are sent once,
   for its smallest document. Anchors with very many contexts send each distinct string
   of WINDOW bytes instead, to the bucket of that string's hash, so that a passage in a
   third of all documents doesn't meet in one bucket.
4. A bucket puts all suffixes of its strings into suffix order, to a depth of WINDOW
   bytes, by prefix doubling. The previous and the next smaller document of a suffix in
   that order are its nearest earlier matches; the longer of their common prefixes with
   it, byte by byte, is its longest previous factor. Where that has WINDOW bytes, the
   window goes.
5. Blocks cut what they are told to cut. Texts are shuffled to make the blocks, in
   compressed bundles, for 1 to 3 together and for the cut.

Exact copies within a block never enter: the first stands for all.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import released, staged, total

WINDOW, GRAM = 50, 25
#: Grams in a window, and the bytes of a context before and after an anchor's start.
GRAMS = WINDOW - GRAM + 1
LEFT, RIGHT = WINDOW - GRAM, WINDOW
WIDE = LEFT + RIGHT
BLOCK = 4 << 20
#: Bytes whose hashes are held at a time, and strings whose suffixes are sorted at a time.
STEP, SUFFIXES = 1 << 18, 1 << 12
#: Occurrences of an anchor from which a block reports them; their sum, and the blocks
#: that have it, from which the anchor's windows are dealt by themselves.
HEAVY, HOT, HOT_BLOCKS = 64, 4096, 256
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of every ``width`` neighbours, by doubling."""
    size = 1
    while size * 2 <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of rows of bytes."""
    places, hashes = [], []
    n = len(data) - GRAM + 1
    ends = offsets[1:]
    for low in range(0, max(n, 0), STEP):
        high = min(n, low + STEP)
        a, b = max(0, low - GRAMS), min(n, high + GRAMS)
        part = data[a : b + GRAM - 1]
        up, down = scan._power(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(scan._BYTE[part] * up[: len(part)], out=sums[1:])
        h = scan.mix((sums[GRAM:] - sums[:-GRAM]) * down[: b - a]) >> np.uint64(1)
        for e in ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b + GRAM)]:
            h[max(0, e - GRAM + 1 - a) : max(0, e - a)] = _NONE  # across a row's end
        pad = np.full(GRAMS - 1, _NONE)
        least = _slide(np.concatenate([pad, h, pad]), GRAMS, np.minimum)
        least[: GRAMS - 1] = least[len(h) :] = 0
        for e in ends[np.searchsorted(ends, a, "right") : np.searchsorted(ends, b + GRAM)]:
            least[max(0, e - GRAM + 1 - a) : max(0, e + GRAMS - 1 - a)] = 0  # no whole string
        chosen = (_slide(least, GRAMS, np.maximum) == h)[low - a : high - a]
        at = np.flatnonzero(chosen) + low
        places.append(at)
        hashes.append(h[at - a])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(places), np.concatenate(hashes)


def packed(x: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte plane, so that shuffles compress
    the planes that are nearly zero."""
    return np.diff(x, prepend=np.zeros(1, np.uint64)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def squeezed(x: np.ndarray) -> bytes:
    """Bytes of an array, compressed better than shuffles do it; the size comes first."""
    return x.nbytes.to_bytes(8, "little") + pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def unsqueezed(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


def _bucket(h: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Buckets of ranges of anchors' hashes that hold about as many anchors each. An
    anchor is the least of GRAMS hashes, so most are small: of hashes from 0 to 1, with w
    of them and v = 1 - w, the part up to w has 1 - (GRAMS + 1) / 2 * v^GRAMS + (GRAMS - 1) / 2
    * v^(GRAMS + 1) of them."""
    v = 1 - (h >> np.uint64(bits - 32)).astype(float) * 2.0**-32
    part = 1 - v**GRAMS * ((GRAMS + 1) - (GRAMS - 1) * v) / 2
    return np.minimum(np.maximum.accumulate((part * buckets).astype(np.int64)), buckets - 1)  # h is sorted


def _bundles(batches):
    """Rows dealt into blocks, as one compressed bundle per block and batch."""
    for batch in batches:
        block = batch.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        rows, out = batch.take(pa.array(order)), []
        for k, part in _by_bucket(block[order]):
            some = rows.slice(part.start, part.stop - part.start)
            data, offsets = scan.bytes_of(some.column("text"))
            carried = pa.table(some.columns[3:], names=[f"_{n}" for n in range(some.num_columns - 3)])
            out.append((k, some.column("id").to_numpy().tobytes(), offsets.tobytes(), squeezed(data), _ipc(carried)))
        yield from _table(BUNDLES, out).to_batches()


def _ipc(table: pa.Table) -> bytes:
    """A small table as bytes; none if it has no columns."""
    if not table.num_columns:
        return b""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unbundled(rows: pa.Table, carried: bool) -> pa.Table:
    parts = []
    for ids, offsets, text, more in zip(*(rows.column(c) for c in ("ids", "offsets", "text", "carried"))):
        n = len(ids.as_py()) // 8
        column = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.as_py()), pa.py_buffer(unsqueezed(text.as_py())))
        part = pa.table({"id": pa.array(np.frombuffer(ids.as_py(), np.int64)), "text": column})
        if carried and more.as_py():
            for name, c in zip((t := pa.ipc.open_stream(more.as_py()).read_all()).column_names, t.columns):
                part = part.append_column(name, c)
        parts.append(part)
    return pa.concat_tables(parts) if parts else pa.table({"id": pa.array([], pa.int64()), "text": pa.array([], pa.large_string())})


def _ordered(rows: pa.Table, carried: bool = False) -> tuple[pa.Table, pa.Table]:
    """A block's rows in order of document: those to look at, and exact copies of
    texts of smaller documents in the block."""
    rows = _unbundled(rows, carried).combine_chunks().sort_by([("id", "ascending"), ("text", "ascending")])
    code = rows.column("text").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ids = rows.column("id").to_numpy()
    first = np.unique(code, return_index=True)[1]
    copy = pa.array(ids > ids[first][code]) if len(ids) else pa.array([], pa.bool_())
    return rows.filter(pa.compute.invert(copy)), rows.filter(copy)


class _Block:
    """A block's rows to look at, their bytes, and their anchors."""

    def __init__(self, rows: pa.Table, bits: int):
        rows = _ordered(rows)[0]
        self.ids = rows.column("id").to_numpy()
        self.data, self.offsets = scan.bytes_of(rows.column("text"))
        self.places, h = anchors(self.data, self.offsets)
        self.hashes = h >> np.uint64(63 - bits)
        self.row = np.searchsorted(self.offsets, self.places, "right") - 1
        self.docs = self.ids[self.row]


def _in_two(h: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Sorted hashes that occur with two different documents."""
    order = np.argsort(h, kind="stable")
    h, docs = h[order], docs[order]
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    return h[first][np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)] if len(h) else h


def _has(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _row_hash(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of bytes."""
    out = np.zeros(len(rows), np.uint64)
    for low in range(0, len(rows), 1 << 16):
        part = rows[low : low + (1 << 16)]
        wide = np.zeros((len(part), -(-rows.shape[1] // 8) * 8), np.uint8)
        wide[:, : rows.shape[1]] = part
        h = out[low : low + len(part)]
        for word in wide.view(np.uint64).T:
            h[:] = scan.mix(h * np.uint64(0xD6E8FEB86659FD93) + word)
    return out


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct row of bytes, and which of them each row is. Hashes
    find equal rows, bytes decide."""
    h = _row_hash(rows)
    one, where = np.unique(h, return_index=True, return_inverse=True)[1:]
    parts = range(0, len(rows), 1 << 16)
    if not all((rows[one[where[a : a + (1 << 16)]]] == rows[a : a + (1 << 16)]).all() for a in parts):  # one hash, other bytes
        plain = np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel()
        one, where = np.unique(plain, return_index=True, return_inverse=True)[1:]
    return one, where.ravel()


def _contexts(block: _Block, chosen: np.ndarray):
    """For chosen anchors: rows of WIDE bytes, and the first and number of windows
    that lie within the document. Bytes outside it are 0."""
    at, row = block.places[chosen], block.row[chosen]
    low, high = block.offsets[row], block.offsets[row + 1]
    where = at[:, None] + np.arange(-LEFT, RIGHT)
    outside = (where < low[:, None]) | (where >= high[:, None])
    rows = block.data[np.clip(where, 0, len(block.data) - 1)]
    rows[outside] = 0
    first = np.maximum(low - at + LEFT, 0)
    windows = np.minimum(high - at - RIGHT, 0) + LEFT + 1 - first
    return rows, first, np.maximum(windows, 0)


BUNDLES = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("offsets", pa.binary()), ("text", pa.binary()), ("carried", pa.binary())])
PARTS = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("heavy", pa.binary())])
SHARED = pa.schema([("block", pa.int64()), ("shared", pa.binary()), ("hot", pa.binary())])
#: To a bucket (or, with bucket -1, to the block itself): strings by their numbers in
#: the block; their documents, first windows and windows, and bytes. A block tells
#: itself where its strings begin, and runs of bytes that it can cut without others.
SENT = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("number", pa.binary()), ("docs", pa.binary()), ("windows", pa.binary()), ("bytes", pa.binary())])
#: What a block is told in the end: by a bucket, masks of windows to cut by number; by
#: itself, the rest.
CUTS = pa.schema([("block", pa.int64()), ("kind", pa.int64()), ("x", pa.binary()), ("y", pa.binary()), ("z", pa.binary())])


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[] for _ in schema], schema.types)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {'long' if f.type == pa.int64() else 'binary'}" for f in schema)


def _by_bucket(bucket: np.ndarray):
    """(bucket, slice) of sorted bucket numbers."""
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
    for a, b in zip(first, [*first[1:], len(bucket)]):
        yield int(bucket[a]), slice(a, b)


def _announce(buckets: int, bits: int, heavy: int):
    def block(key, rows):
        b, out = _Block(rows, bits), []
        h, n = np.unique(b.hashes, return_counts=True)
        for k, part in _by_bucket(_bucket(h, buckets, bits)):
            many = n[part] >= heavy
            out.append((key[0].as_py(), k, packed(h[part]), np.r_[h[part][many], n[part][many].astype(np.uint64)].tobytes()))
        return _table(PARTS, out)

    return block


def _compare(hot_from: int, hot_blocks: int):
    def _compare_bucket(key, rows):
        """Which hashes of each block others have too, and which are hot."""
        blobs = [unpacked(x.as_py()) for x in rows.column("hashes")]
        every, blocks = np.unique(np.concatenate(blobs), return_counts=True)
        heavy = [np.frombuffer(x.as_py(), np.uint64).reshape(2, -1) for x in rows.column("heavy")]
        values, where = np.unique(np.concatenate([x[0] for x in heavy]), return_inverse=True)
        sums = np.bincount(where, np.concatenate([x[1] for x in heavy]).astype(float), len(values))
        hot = np.union1d(values[sums >= hot_from], every[blocks >= hot_blocks])
        out = []
        for b, h in zip(rows.column("block"), blobs):
            mine, warm = h[_has(every[blocks > 1], h)], h[_has(hot, h)]
            if len(mine) or len(warm):
                out.append((b.as_py(), packed(mine), packed(warm)))
        return _table(SHARED, out)

    return _compare_bucket


def _chosen(block: _Block, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the anchors that occur in two documents, and which are hot."""
    gather = lambda c: np.sort(np.concatenate([unpacked(x.as_py()) for x in told.column(c)] + [np.zeros(0, np.uint64)]))
    shared, hot = gather("shared"), gather("hot")
    own = _in_two(block.hashes, block.docs)
    at = np.flatnonzero(_has(shared, block.hashes) | _has(own, block.hashes))
    return at, _has(hot, block.hashes[at])


def _strings(block: _Block, told: pa.Table, bits: int):
    """The block's strings to compare. Of each occurrence: the byte where the string
    starts, how far on its first window does, its windows, row and distinct
    string; of each distinct string: its bytes, first window and windows, and route."""
    at, hot = _chosen(block, told)
    # a block has fewer than 2^31 bytes; a passage that many documents share has very many
    # occurrences, so they are kept small
    kinds = (np.int32, np.uint8, np.uint8, np.int32, np.int32)
    base, skip, count, row, number = ([np.zeros(0, t)] for t in kinds)
    marked, routes, seen = [np.zeros((0, WIDE + 2), np.uint8)], [np.zeros(0, np.uint64)], 0

    def add(of, begin, first, windows, rows, route):
        nonlocal seen
        both = np.c_[rows, first.astype(np.uint8), windows.astype(np.uint8)]
        one, where = _distinct(both)
        for x, y, t in zip((base, skip, count, row, number), (begin, first, windows, block.row[of], where + seen), kinds):
            x.append(y.astype(t))
        marked.append(both[one])
        routes.append(_row_hash(both[one]) >> np.uint64(64 - bits) if route is None else route[one])
        seen += len(one)

    for low in range(0, len(at), 1 << 14):
        part, warm = at[low : low + (1 << 14)], hot[low : low + (1 << 14)]
        rows, first, windows = _contexts(block, part)
        cold = ~warm & (windows > 0)
        add(part[cold], block.places[part[cold]] - LEFT, first[cold], windows[cold], rows[cold], block.hashes[part[cold]])
        for some in np.array_split(np.flatnonzero(warm), -(-int(warm.sum()) // (1 << 11)) or 1):  # GRAMS strings each
            each = np.repeat(some, windows[some])
            if not len(each):
                continue
            shift = first[each] + np.arange(len(each)) - np.repeat(np.cumsum(windows[some]) - windows[some], windows[some])
            single = np.full((len(each), WIDE), 255, np.uint8)  # no byte of UTF-8, so never equal to a context
            single[:, :WINDOW] = rows[each[:, None], shift[:, None] + np.arange(WINDOW)]
            add(part[each], block.places[part[each]] - LEFT + shift, np.zeros(len(each), np.int64), np.ones(len(each), np.int64), single, None)
    every = np.concatenate(marked)
    one, where = _distinct(every)
    strings = every[one, :WIDE], every[one, WIDE:], np.concatenate(routes)[one]
    return [np.concatenate(x) for x in (base, skip, count, row)], where.astype(np.int32)[np.concatenate(number)], strings


def _send(buckets: int, bits: int):
    def block(key, rows, told):
        if not rows.num_rows:
            return _table(SENT, [])
        b = _Block(rows, bits)
        (base, skip, count, row), number, (text, windows, route) = _strings(b, told, bits)
        docs = b.ids[row]
        least = np.full(len(text), np.iinfo(np.int64).max)
        np.minimum.at(least, number, docs)
        mine = docs == least[number]
        cut, order = ~mine, np.argsort(base[mine], kind="stable")
        own = (base[mine][order] + LEFT, number[mine][order])
        start = base[cut].astype(np.int64) + skip[cut]
        out = [(key[0].as_py(), -1, own[1].astype(np.uint32).tobytes(), packed(own[0].astype(np.uint64)), None, _runs(start, start + count[cut] + WINDOW - 1).tobytes())]
        route = scan.mix(route) >> np.uint64(1)  # routes of anchors are small ones mostly
        order = np.argsort(route, kind="stable")
        for k, part in _by_bucket((((route[order] >> np.uint64(31)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)):
            i = order[part]
            out.append((key[0].as_py(), k, i.astype(np.uint32).tobytes(), squeezed(least[i]), windows[i].tobytes(), squeezed(text[i])))
        return _table(SENT, out)

    return block


def _runs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of half-open runs, as rows of begin and end."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order]) if len(b) else b
    new = np.r_[True, a[1:] > b[:-1]] if len(a) else np.zeros(0, bool)
    last = np.r_[new[1:], True] if len(a) else new
    return np.c_[a[new], b[last]].astype(np.int64)


def _rank(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].reshape(x.shape).astype(np.uint64)


def _eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of rows of WIDE bytes, as a number."""
    n = WIDE - 8 + 1
    out = np.zeros((len(text), n), np.uint64)
    for j in range(8):
        out <<= np.uint64(8)
        out |= text[:, j : j + n]
    return out


def window_ranks(text: np.ndarray) -> np.ndarray:
    """Ranks of the first WINDOW bytes of the suffixes at the first GRAMS places of
    rows of WIDE bytes: suffix order to that depth, by prefix doubling."""
    rank, depth = _rank(_eights(text)), 8
    while depth * 2 <= WINDOW:
        rank = _rank(rank[:, :-depth] << np.uint64(32) | rank[:, depth:])
        depth *= 2
    over = WINDOW - depth
    return _rank(rank[:, :GRAMS] << np.uint64(32) | rank[:, over : over + GRAMS])


def smaller_before(docs: np.ndarray) -> np.ndarray:
    """For each place of a row of numbers the nearest place before it with a smaller
    number, -1 if there is none: halving steps over minima of 1, 2, 4 ... numbers."""
    n = len(docs)
    lows, size = [docs], 1  # the minima of the ``size`` numbers up to each place
    while size * 2 <= n:
        x = lows[-1].copy()
        np.minimum(x[size:], lows[-1][:-size], out=x[size:])
        lows.append(x)
        size *= 2
    at = np.arange(-1, n - 1)
    for low in reversed(lows):
        inside = at >= 0
        skip = inside & (low[np.where(inside, at, 0)] >= docs)
        at[skip] -= size
        size //= 2
    return np.maximum(at, -1)


def _common(text: np.ndarray, row: np.ndarray, place: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Bytes, up to WINDOW, that suffixes (by row and place) have in common with the
    ``other``s, 0 for other -1."""
    eights, out = _eights(text), np.zeros(len(row), np.int64)
    begin = row * eights.shape[1] + place
    eights = eights.ravel()
    some = np.flatnonzero(other >= 0)
    for j in [*range(0, WINDOW - 8, 8), WINDOW - 8]:  # those that still agree, eight bytes further
        differ = eights[begin[some] + j] ^ eights[begin[other[some]] + j]
        out[some] = j + sum((differ < np.uint64(1 << 8 * i)).astype(np.int64) for i in range(8))
        some = some[differ == 0]
    return out


def previous_factors(text: np.ndarray, windows: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, longest previous factor) of the suffixes of strings at their
    windows, in suffix order. The factor, of up to WINDOW bytes, is the longest that a
    suffix has in common with one of a smaller document."""
    rank = window_ranks(text)
    j = np.arange(GRAMS)
    row, place = np.nonzero((j >= windows[:, :1]) & (j < windows.sum(axis=1, dtype=np.int64)[:, None]))
    suffix = np.argsort(rank[row, place])  # equal ones in any order
    row, place = row[suffix], place[suffix]
    d = np.unique(docs, return_inverse=True)[1].astype(np.int32)[row]
    before = smaller_before(d)
    after = len(d) - 1 - smaller_before(d[::-1])[::-1]
    after[after == len(d)] = -1
    return row, place, np.maximum(_common(text, row, place, before), _common(text, row, place, after))


def _earlier(text: np.ndarray, windows: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Masks of the windows of each distinct string that a smaller document has."""
    mask = np.zeros(len(text), np.uint32)
    row, place, factor = previous_factors(text, windows, docs)
    found = factor >= WINDOW
    np.bitwise_or.at(mask, row[found], np.uint32(1) << place[found].astype(np.uint32))
    return mask


def _decide(key, rows):
    """For the strings of a bucket, masks of the windows to cut; what a block tells
    itself goes on to it."""
    if key[0].as_py() < 0:
        return _table(CUTS, [(b, 0, x, y, z) for b, x, y, z in zip(*(rows.column(c).to_pylist() for c in ("block", "number", "docs", "bytes")))])
    join = lambda c, t, plain=unsqueezed: np.concatenate([np.frombuffer(plain(x.as_py()), t) for x in rows.column(c)])
    docs, windows, text = join("docs", np.int64), join("windows", np.uint8, bytes).reshape(-1, 2), join("bytes", np.uint8).reshape(-1, WIDE)
    both = np.c_[text, windows]
    del text, windows
    one, where = _distinct(both)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, where, docs)
    both = both[one]
    text, windows = both[:, :WIDE], both[:, WIDE:]
    mask = np.zeros(len(one), np.uint32)
    gram = _row_hash(text[:, LEFT : LEFT + GRAM])
    order = np.argsort(gram, kind="stable")
    first = np.flatnonzero(np.r_[True, gram[order][1:] != gram[order][:-1]])
    sizes = np.diff(np.r_[first, len(order)])
    mixed = np.repeat(sizes > 1, sizes)
    order, begin = order[mixed], 0
    gram = gram[order]
    while begin < len(order):
        end = min(len(order), begin + SUFFIXES)
        if end < len(order):
            low = begin + int(np.searchsorted(gram[begin:], gram[end]))
            end = low if low > begin else begin + int(np.searchsorted(gram[begin:], gram[end], "right"))
        i = order[begin:end]
        mask[i] = _earlier(text[i], windows[i], least[i])
        begin = end
    every = ((np.int64(1) << windows[:, 1].astype(np.int64)) - 1 << windows[:, 0].astype(np.int64)).astype(np.uint32)
    out = np.where(docs > least[where], every[where], mask[where])
    result, at = [], 0
    for b, x in zip(rows.column("block"), rows.column("number")):
        number = np.frombuffer(x.as_py(), np.uint32)
        m = out[at : at + len(number)]
        at += len(number)
        if m.any():
            result.append((b.as_py(), 1, number[m > 0].tobytes(), m[m > 0].tobytes(), None))
    return _table(CUTS, result)


KEPT = "id long, kept binary, n_bytes long, n_removed long, n_spans long"
KEPT_SCHEMA = pa.schema([("id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])


def _cut(key, rows, told):
    if not rows.num_rows:  # cannot be: what is told comes from the block's own rows
        return _table(KEPT_SCHEMA, [])
    rows, copies = _ordered(rows, True)
    data, offsets = scan.bytes_of(rows.column("text"))
    edge = np.zeros(len(data) + 1, np.int64)
    masks = np.zeros(0, np.uint32)
    own = []
    for kind, x, y, z in zip(*(told.column(c).to_pylist() for c in ("kind", "x", "y", "z"))):
        if kind == 1:
            number, m = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
            if int(number.max()) >= len(masks):
                masks = np.r_[masks, np.zeros(int(number.max()) + 1 - len(masks), np.uint32)]
            masks[number] = m
        else:
            runs = np.frombuffer(z, np.int64).reshape(-1, 2)
            np.add.at(edge, runs[:, 0], 1)
            np.add.at(edge, runs[:, 1], -1)
            own.append((np.frombuffer(x, np.uint32), unpacked(y).astype(np.int64)))
    for number, start in own:
        known = number < len(masks)
        number, start = number[known], start[known] - LEFT
        m = masks[number]
        for j in range(GRAMS):
            at = start[(m >> np.uint32(j)) & np.uint32(1) == 1] + j
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
    gone = np.cumsum(edge[:-1]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    begins[inner] |= gone[inner]
    sums, spans = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(begins)]
    left = data[~gone].tobytes()
    at = offsets - sums[offsets]
    kept = [left[a:b] for a, b in zip(at, at[1:])]
    diff = lambda x: pa.array(np.diff(x), pa.int64())
    out = pa.Table.from_arrays([rows.column("id"), pa.array(kept, pa.binary()), diff(offsets), diff(sums[offsets]), diff(spans[offsets])], schema=KEPT_SCHEMA)
    n = pa.compute.binary_length(copies.column("text").cast(pa.binary())).cast(pa.int64())
    whole = [copies.column("id"), pa.array([b""] * len(copies), pa.binary()), n, n, pa.array(np.ones(len(copies), np.int64))]
    out = pa.concat_tables([out, pa.Table.from_arrays(whole, schema=KEPT_SCHEMA)])
    both = pa.concat_tables([rows, copies])
    for name in both.column_names[2:]:
        out = out.append_column(name, both.column(name))
    return out


def _grouped(f):
    rest = released(f)
    return lambda key, rows: rest(key, rows)


def _cogrouped(f):
    rest = released(f)
    return lambda key, rows, told: rest(key, rows, told)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block_bytes: int = BLOCK, heavy: int = HEAVY, hot: int = HOT, hot_blocks: int = HOT_BLOCKS, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, kept (the remaining bytes), n_bytes, n_removed,
    n_spans (maximal removed runs), and the columns to ``carry``.

    A null text counts as empty. Texts under WINDOW bytes stay whole. Rows with equal
    ids never take bytes from each other. A row with a null id stays whole and takes
    nothing from others. Other columns are ignored; an empty table gives no rows."""
    kinds, names = dict(docs.dtypes), [f"_{n}" for n in range(len(carry))]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(n) for c, n in zip(carry, names)))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    long = rows.where(F.col("n_bytes") >= WINDOW).where("id is not null")
    n = total(long, "n_bytes")
    blocks = max(1, -(-n // block_bytes))
    bits = max(32, min(55, n.bit_length() + 8))
    buckets = max(blocks, 12)
    dealt = long.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), *names).mapInArrow(_bundles, _ddl(BUNDLES))
    parts = dealt.groupBy("block").applyInArrow(_grouped(_announce(buckets, bits, heavy)), _ddl(PARTS))
    shared = parts.groupBy("bucket").applyInArrow(_grouped(_compare(hot, hot_blocks)), _ddl(SHARED))
    sent = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_cogrouped(_send(buckets, bits)), _ddl(SENT))
    to = F.when(F.col("bucket") < 0, -1 - F.col("block")).otherwise(F.col("bucket"))
    told = staged(sent.withColumn("to", to).groupBy("to").applyInArrow(_grouped(_decide), _ddl(CUTS)), "cuts")
    done = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_cogrouped(_cut), KEPT + "".join(f", {n} {kinds[c]}" for c, n in zip(carry, names)))
    zero = F.lit(0).cast("long")
    whole = rows.where((F.col("n_bytes") < WINDOW) | F.col("id").isNull()).select("id", F.col("text").cast("binary").alias("kept"), "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), *names)
    return done.union(whole).select(F.col("id").alias(id_col), "kept", "n_bytes", "n_removed", "n_spans", *(F.col(n).alias(c) for c, n in zip(carry, names)))

"""Best-fit packing of token pieces by linear grouping.

Each shard of pieces is packed by itself. Lengths over ``SMALL`` are sorted and cut
into ``GROUPS`` groups of equal cardinality, and rounded up to their group's largest.
Over these few sizes the number of sequences is optimised as a linear program over all
configurations that fit into a sequence; those that can improve it are found one by one
by dynamic programming over the capacity (column generation). As many sequences of each
configuration are opened as the optimum has whole ones, and each slot is filled by an
actual document of its group. What is left of fractions, and then the small pieces, go
where they leave least room (best fit, largest first). Sequences of one shard that stay
below half are at most one, so shards cost next to nothing in sequences.
"""

from __future__ import annotations

import os
import re
import struct
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, staged

CAPACITY, SMALL, GROUPS, SHARD = 4096, 512, 24, 40_000


class WordCache:
    """Token ids of texts by a tokenizer file, remembering those of chunks
    between blanks, and of the runs of letters and of other characters in them.

    Only for word_bpe_49k and files with its normaliser and pattern, which drop white
    space and encode each run by itself. Chunks that it is not sure of go to the file's
    own tokenizer."""

    #: Entries of the caches (chunks twice, new and old), and the characters of the
    #: longest that stays in one.
    CHUNKS, RUNS, LONG = 800_000, 800_000, 48

    def __init__(self, path: str):
        import unicodedata

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        # the byte-level alphabet: bytes that print stand for themselves, the others for what follows 255
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: b if b in shown else 256 + n for n, b in enumerate(sorted(set(range(256)) - set(shown)) + shown)}
        none = [i for i in range(0x110000) if unicodedata.category(chr(i)) == "Cn"]
        ends = np.flatnonzero(np.diff(none) > 1)
        ranges = zip(np.r_[0, ends + 1], np.r_[ends, len(none) - 1])
        self.unassigned = re.compile("[" + "".join(f"\\U{none[a]:08x}-\\U{none[b]:08x}" for a, b in ranges) + "]")
        self.rare = re.compile(f"[{chr(none[0])}-\U0010ffff]")  # all before are assigned
        self.chunks: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}

    def _plain(self, text: str) -> bool:
        """Whether the runs of the lower-cased text are what the file's normaliser and
        pattern make of it: no added tokens, nothing to compose, no letter whose lower
        case depends on others, nothing that other Unicode tables may know better."""
        import unicodedata

        if "<|" in text:
            return False
        if text.isascii():
            return True
        low = text.lower()
        if "Σ" in text or len(low) != len(text) or not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", low)):
            return False
        return not (self.rare.search(text) and self.unassigned.search(text))

    def _learn(self, chunks: list[str]) -> None:
        if not chunks:
            return
        joined = " ".join(chunks)
        if self._plain(joined):
            plain, lows = chunks, joined.lower().split(" ")
        else:
            plain = [c for c in chunks if self._plain(c)]
            lows, odd = [c.lower() for c in plain], set(chunks) - set(plain)
            for c, e in zip(odd, self.tokenizer.encode_batch_fast(list(odd), add_special_tokens=False)):
                self.chunks[c] = np.array(e.ids, "<u4").tobytes()
        split = [[x] if x.isascii() and x.isalpha() else self.pattern.findall(x) for x in lows]
        runs = {r for p in split for r in p if r not in self.runs}
        if len(self.runs) + len(runs) > self.RUNS:
            self.runs.clear()
            runs = {r for p in split for r in p}
        tokenize = self.tokenizer.model.tokenize
        for r in runs:  # byte by byte, as the file's byte level hands it to the model
            ids = [t.id for t in tokenize(r.encode().decode("latin-1").translate(self.alphabet))]
            self.runs[r] = struct.pack(f"<{len(ids)}I", *ids)
        get = self.runs.__getitem__
        self.chunks.update(zip(plain, [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in split]))
        for r in runs:
            if len(r) > self.LONG:
                del self.runs[r]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        words = text.replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.chunks.__getitem__, words))
        except KeyError:
            pass
        fresh = {w for w in words if w not in self.chunks}
        if len(self.chunks) + len(fresh) > self.CHUNKS:  # what comes again is kept
            self.old, self.chunks, fresh = self.chunks, {}, set(words)
        known = fresh & self.old.keys()
        self.chunks.update((w, self.old[w]) for w in known)
        self._learn(list(fresh - known))
        out = b"".join(map(self.chunks.__getitem__, words))
        for w in fresh:
            if len(w) > self.LONG:
                del self.chunks[w]
        return out


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, end: int = 1, ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids_crc32 and,
    if asked for, ids. A text's ids end with ``end``; only texts with more than
    ``capacity`` ids are cut. Null and empty texts have the one id ``end``."""
    names = [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * ids
    tail = np.array([end], "<u4").tobytes()

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caches = held("packing")
        if tokenizer not in caches:
            caches[tokenizer] = WordCache(tokenizer)
        encode = caches[tokenizer].encode
        for batch in it:
            cols: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode(text.as_py() or "") + tail
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    row = [doc, n, at // 4, len(part) // 4, zlib.crc32(part)]
                    for c, x in zip(cols, row + [part] * ids):
                        c.append(x)
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    ddl = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(batches, ddl)


def best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is in the most valuable configuration that fits: a knapsack,
    one more slot a round."""
    best, choice = np.zeros(capacity + 1), []
    while True:
        more, pick = best.copy(), np.full(capacity + 1, -1)
        for i, (size, v) in enumerate(zip(sizes.tolist(), value.tolist())):
            if v > 0 and size <= capacity:
                better = best[: capacity + 1 - size] + v > more[size:] + 1e-12
                more[size:][better] = best[: capacity + 1 - size][better] + v
                pick[size:][better] = i
        if (pick < 0).all():
            break
        choice.append(pick)
        best = more
    out, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(choice):
        if pick[room] >= 0:
            out[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, group numbers of the slots) of sequences over rounded sizes, of which
    there are so many each. The linear program for the fewest sequences is solved by
    column generation, and each configuration is used as often as its optimum has
    whole sequences."""
    if not sizes:
        return []
    size, want = np.array(sizes), np.array(counts, float)
    basis = np.diag((capacity // size).astype(float))
    times = want / (capacity // size)
    for _ in range(100 * len(sizes)):  # far more than it takes
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        new = best_pattern(size, worth, capacity)
        if new @ worth <= 1 + 1e-9:
            break
        change = np.linalg.solve(basis, new.astype(float))
        steps = np.where(change > 1e-9, times / np.where(change > 1e-9, change, 1), np.inf)
        out = int(steps.argmin())
        step = steps[out]
        times = np.maximum(times - step * change, 0)
        times[out] = step
        basis[:, out] = new
    else:  # a packing like any other, only not known to be the best
        warnings.warn(f"column generation over {len(sizes)} sizes stopped short of its optimum", RuntimeWarning, stacklevel=2)
    return [(int(t + 1e-6), np.repeat(np.arange(len(sizes)), c.astype(int)).tolist()) for t, c in zip(times, basis.T) if t + 1e-6 >= 1]


def pack(lengths: np.ndarray, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every length (1 to ``capacity``)."""
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    large = order[lengths[order] > small]
    rest = order[len(large) :]
    room: list[int] = []
    if len(large):
        parts = np.array_split(large, min(groups, len(large)))
        sizes, counts = [int(lengths[p[0]]) for p in parts], [len(p) for p in parts]
        merged: dict[int, list[int]] = {}
        for size, p in zip(sizes, parts):
            merged.setdefault(size, []).extend(p.tolist())
        sizes, stock = list(merged), list(merged.values())
        for times, slots in configurations(sizes, [len(s) for s in stock], capacity):
            for _ in range(times):
                used = 0
                for g in slots:
                    if stock[g]:
                        i = stock[g].pop()
                        sequence[i], offset[i] = len(room), used
                        used += int(lengths[i])
                room.append(capacity - used)
        left = np.array(sorted((i for s in stock for i in s), key=lambda i: (-lengths[i], i)), np.int64)
        rest = np.concatenate([left, rest])
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0
    for s, r in enumerate(room):
        by_room[r].append(s)
        open_ |= 1 << r
    for i in rest.tolist():
        size = int(lengths[i])
        fits = open_ >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            s = by_room[r].pop()
            if not by_room[r]:
                open_ &= ~(1 << r)
        else:
            s, r = len(room), capacity
            room.append(capacity)
        sequence[i], offset[i] = s, capacity - r
        r -= size
        room[s] = r
        by_room[r].append(s)
        open_ |= 1 << r
    return sequence, offset


def packed(parts: DataFrame, *, capacity: int = CAPACITY, shard_rows: int = SHARD) -> DataFrame:
    """``parts`` (with length) plus sequence_id and offset. Every sequence holds at
    most ``capacity`` ids, without gaps. Sequences never span shards of about
    ``shard_rows`` pieces, dealt by a hash of the rows."""
    rows = parts.count()
    shards = max(1, -(-rows // shard_rows))
    names = parts.columns

    def shard(key, table):
        table = table.combine_chunks()
        sequence, offset = pack(table.column("length").to_numpy(), capacity)
        sequence = sequence * shards + key[0].as_py()
        table = table.select(names)
        return table.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    dealt = parts.withColumn("_shard", F.pmod(F.xxhash64(*names), F.lit(shards)))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema) + ", sequence_id long, offset long"
    return dealt.groupBy("_shard").applyInArrow(shard, ddl)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY) -> DataFrame:
    """Packs the token ids of all rows of ``docs`` into sequences of at most
    ``capacity``; one row per piece. Rows that repeat an id are documents of their own.
    An empty table packs into nothing."""
    return packed(staged(pieces(docs, tokenizer, id_col, text_col, capacity=capacity), "pieces"), capacity=capacity)


def sequences(parts: DataFrame) -> DataFrame:
    """sequence_id, ids: the ids of packed pieces (with ids) put together in order."""
    def join(key, table):
        order = np.argsort(table.column("offset").to_numpy(), kind="stable")
        data = table.column("ids").to_pylist()
        return pa.table({"sequence_id": pa.array([key[0].as_py()], pa.int64()), "ids": pa.array([b"".join(data[i] for i in order)], pa.binary())})

    return parts.groupBy("sequence_id").applyInArrow(join, "sequence_id long, ids binary")

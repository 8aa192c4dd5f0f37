"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary, and its single bytes. Each language
has a probability for every piece, fitted by EM; the forward algorithm sums the
probability of a word over all its segmentations into pieces, and a text's is the
product over its words. Words are runs of letters (ASCII in lower case, and everything
beyond ASCII) of at most ``LONGEST`` bytes; longer runs are cut by bytes, within a
character too, as every single byte is a piece.

Each batch of texts is reduced to its distinct words first, and the forward algorithm
runs over all of them at once, a byte at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import held, slices

LONGEST, ROUNDS, FLOOR = 32, 4, 1e-9
#: Expected documents of a language that are fitted on, and the distinct words of each.
SAMPLE, WORDS = 2000, 20_000

LETTERS = np.zeros(256, bool)
LETTERS[97:123] = LETTERS[128:] = True
_LETTER = regex.compile(r"\p{L}")


class Vocabulary:
    """Piece numbers by hash of their bytes; the last 256 are single bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = {model.id_to_piece(i).lstrip("▁").lower().encode() for i in range(model.get_piece_size())}
        keep = sorted(t for t in texts if 1 < len(t) <= LONGEST // 2 and all(LETTERS[b] for b in t)) + [bytes([b]) for b in range(256)]
        self.size, self.widest = len(keep), max(map(len, keep))
        data = np.frombuffer(b"".join(keep), np.uint8)
        ends = np.cumsum([len(t) for t in keep])
        h = _substrings(data, ends - [len(t) for t in keep], ends)
        order = np.argsort(h)
        self.hashes, self.pieces = h[order], order.astype(np.int32)
        self.some = np.zeros(1 << 20, bool)
        self.some[(h >> np.uint64(44)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers of hashes, -1 for none."""
        out = np.full(len(h), -1, np.int32)
        at = np.flatnonzero(self.some[(h >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.hashes, h[at]), self.size - 1)
        same = self.hashes[place] == h[at]
        out[at[same]] = self.pieces[place[same]]
        return out


def _substrings(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    up, down = scan._power(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(scan._BYTE[data] * up[: len(data)], out=sums[1:])
    return scan.mix((sums[b] - sums[a]) * down[a])


def _lattice(words: list[bytes], vocabulary: Vocabulary):
    """Pieces in words of one length class: (word, end, width, piece), by end."""
    data = np.frombuffer(b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    base = np.cumsum(size) - size
    out = []
    for end in range(1, int(size.max(initial=0)) + 1):
        for width in range(1, min(end, vocabulary.widest) + 1):
            word = np.flatnonzero(size >= end)
            piece = vocabulary.find(_substrings(data, base[word] + end - width, base[word] + end))
            hit = piece >= 0
            if hit.any():
                out.append((word[hit], end, width, piece[hit]))
    return size, out


def forward(words: list[bytes], vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Log probabilities of words (rows) by language (columns of ``p``)."""
    out = np.zeros((len(words), p.shape[1]))
    order = np.argsort([len(w) for w in words], kind="stable")
    for low in range(0, len(words), 16_384):
        part = order[low : low + 16_384]
        size, lattice = _lattice([words[i] for i in part], vocabulary)
        alpha = np.zeros((int(size.max()) + 1, len(part), p.shape[1]))
        alpha[0] = 1
        for word, end, width, piece in lattice:
            alpha[end, word] += alpha[end - width, word] * p[piece]
        out[part] = np.log(np.maximum(alpha[size, np.arange(len(part))], 1e-300))
    return out


def fitted(words: list[bytes], counts: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Piece probabilities of one language by EM over all segmentations."""
    p = np.full((vocabulary.size, 1), 1.0 / vocabulary.size)
    order = np.argsort([len(w) for w in words], kind="stable")
    parts = []
    for low in range(0, len(words), 16_384):
        part = order[low : low + 16_384]
        parts.append((counts[part], *_lattice([words[i] for i in part], vocabulary)))
    for _ in range(ROUNDS):
        expected = np.zeros(vocabulary.size)
        for count, size, lattice in parts:
            n = len(size)
            alpha = np.zeros((int(size.max()) + 1, n))
            beta = np.zeros_like(alpha)
            alpha[0] = 1
            for word, end, width, piece in lattice:
                alpha[end, word] += alpha[end - width, word] * p[piece, 0]
            beta[size, np.arange(n)] = 1
            for word, end, width, piece in reversed(lattice):
                beta[end - width, word] += beta[end, word] * p[piece, 0]
            whole = np.maximum(alpha[size, np.arange(n)], 1e-300)
            for word, end, width, piece in lattice:
                np.add.at(expected, piece, count[word] * alpha[end - width, word] * p[piece, 0] * beta[end, word] / whole[word])
        p = ((expected + FLOOR * expected.sum() + 1e-12) / (expected.sum() * (1 + FLOOR * vocabulary.size) + 1e-12 * vocabulary.size))[:, None]
    return p[:, 0]


def _distinct(column: pa.Array):
    """A column's distinct words, and per row the numbers of its words (with where the
    rows begin)."""
    h, begin, a, b = scan.words(column, LETTERS, places=True)
    if not len(h):
        return [], h.astype(np.int64), begin
    _, one, number = np.unique(h, return_index=True, return_inverse=True)
    data = scan.LOWER[scan.bytes_of(column)[0]]
    buffer = data.tobytes()
    return [buffer[x:y] for x, y in zip(a[one].tolist(), b[one].tolist())], number, begin


def _cut(words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words of at most LONGEST bytes, and which word each belongs to."""
    if all(len(w) <= LONGEST for w in words):
        return words, np.arange(len(words))
    out, of = [], []
    for i, w in enumerate(words):
        for at in range(0, len(w), LONGEST):
            out.append(w[at : at + LONGEST])
            of.append(i)
    return out, np.array(of)


def word_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """lang, word, n over the rows of ``docs``."""

    def batches(it):
        for batch in slices(it, "text"):
            langs = batch.column(0).to_pylist()
            words, number, begin = _distinct(batch.column(1))
            row = np.repeat(np.arange(len(langs)), np.diff(begin))
            by = {x: i for i, x in enumerate(sorted(set(langs)))}
            key = np.array([by[x] for x in langs], np.int64)[row] * max(1, len(words)) + number
            key, n = np.unique(key, return_counts=True)
            names = sorted(by)
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[k] for k in key // max(1, len(words))], pa.string()), pa.array([words[k] for k in key % max(1, len(words))], pa.binary()), pa.array(n, pa.int64())],
                names=["lang", "word", "n"],
            )

    counts = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).mapInArrow(batches, "lang string, word binary, n long")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, vocabulary: str, lang_col: str = "lang", text_col: str = "text", key: Column | None = None, *, sample: int = SAMPLE, words: int = WORDS) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities. Of each language about ``sample`` rows
    are used, those with the smallest hashes of ``key``, and of those the ``words``
    most frequent words, so what comes to the driver is bounded by the number of
    languages. Rows with null text or language are not used."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).withColumn("_part", F.pmod(F.xxhash64(key if key is not None else F.col(text_col)), F.lit(1 << 20)))
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}
    if not sizes:
        return [], np.zeros((0, 0))
    share = F.lit(0)
    for lang, n in sizes.items():
        share = F.when(F.col(lang_col) == lang, int((1 << 20) * min(1.0, sample / n))).otherwise(share)
    counts = word_counts(rows.where(F.col("_part") < share), lang_col, text_col)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= words).select("lang", "word", "n").collect()
    v = Vocabulary(vocabulary)
    langs = sorted(sizes)
    p = np.zeros((v.size, len(langs)))
    for k, lang in enumerate(langs):
        mine = [(bytes(r["word"]), r["n"]) for r in top if r["lang"] == lang]
        cut, of = _cut([w for w, _ in mine])
        n = np.array([n for _, n in mine], float)
        p[:, k] = fitted(cut, n[of], v) if mine else 1.0 / v.size
    return langs, p


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", *, carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: id, the columns to ``carry``, lang_pred, score (the
    posterior of the best language, all being as likely before). Null, empty and letterless texts are ``und``
    with score 0, as is every text if no language was learned; ties go to the first
    language by name. Other columns are ignored."""
    out = list(dict.fromkeys([id_col, *carry]))

    def batches(it):
        vocabularies = held("languages")
        if vocabulary not in vocabularies:
            vocabularies[vocabulary] = Vocabulary(vocabulary)
        v = vocabularies[vocabulary]
        for batch in slices(it, text_col):
            text = batch.column(text_col)
            words, number, begin = _distinct(text)
            rows = batch.num_rows
            total = np.zeros((rows, max(1, len(langs))))
            if words and langs:
                cut, of = _cut(words)
                each = np.zeros((len(words), len(langs)))
                np.add.at(each, of, forward(cut, v, p))
                sums = np.zeros((len(number) + 1, len(langs)))
                np.cumsum(each[number], axis=0, out=sums[1:])
                total = sums[begin[1:]] - sums[begin[:-1]]
            total -= total.max(axis=1, keepdims=True)
            share = np.exp(total)
            share /= share.sum(axis=1, keepdims=True)
            best = share.argmax(axis=1)
            pred, score = [], []
            for i, t in enumerate(text):
                known = langs and begin[i + 1] > begin[i] and _LETTER.search(t.as_py())
                pred.append(langs[best[i]] if known else "und")
                score.append(float(share[i, best[i]]) if known else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in out), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*out, "lang_pred", "score"])

    kinds = dict(docs.dtypes)
    return docs.select(*dict.fromkeys([*out, text_col])).mapInArrow(batches, "".join(f"`{c}` {kinds[c]}, " for c in out) + "lang_pred string, score double")

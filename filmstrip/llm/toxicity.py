"""Toxicity: a convolutional text classifier over hashed words, in numpy.

A word's embedding is the sum of two rows, that of its hash and that of its first
``HEAD`` bytes' hash, so that words of one stem have something in common. Filters of several
widths slide over a text, each filter's largest activation is kept, and a logistic layer
scores them. Embeddings, filters and the last layer start at random and are trained
together by Adam, on minibatches with as many toxic texts as others and with dropout
before the last layer. As a filter is linear up to its largest value, scoring needs only
sums of precomputed rows, one per word, hash and place in the filter.

Thresholds are calibrated by language: the model also learns how likely each row is in
each language, guesses a text's language from its words, and shifts the score so that
the language's best threshold on rows kept out of the fit becomes ``THRESHOLD``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .common import slices

ROWS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
EPOCHS, MINIBATCH, RATE, EMBEDDING_RATE, DROPOUT = 6, 32, 0.005, 0.01, 0.3
HEAD = 6
#: Expected labelled documents of each label that are fitted on, and bytes of the longest.
SAMPLE, LONGEST = 2500, 1 << 15
THRESHOLD = 0.7


def rows_of(h: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Two embedding rows per word, those of its head behind the words'."""
    return np.stack([h >> np.uint64(48), (head >> np.uint64(48)) + np.uint64(ROWS)], axis=1).astype(np.int32)


class _Adam:
    """Adam's moments of one array; with ``at``, of some rows of it."""

    def __init__(self, p: np.ndarray, rate: float, second: float = 0.999):
        self.p, self.rate, self.second, self.m, self.s, self.step = p, rate, second, np.zeros_like(p), np.zeros_like(p), 0

    def move(self, g: np.ndarray, at=slice(None)) -> None:
        self.step += 1
        m = self.m[at] = 0.9 * self.m[at] + 0.1 * g
        s = self.s[at] = self.second * self.s[at] + (1 - self.second) * g * g
        if isinstance(at, slice):
            m, s = m / (1 - 0.9**self.step), s / (1 - self.second**self.step)
        self.p[at] -= self.rate * m / (np.sqrt(s) + 1e-8)


class Model:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.e = normal(0.1, 2 * ROWS, DIM)
        self.w = {w: normal(1 / np.sqrt(w * DIM), w, DIM, FILTERS) for w in WIDTHS}
        self.c = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.v = normal(0.3, len(WIDTHS) * FILTERS)
        self.b = np.zeros(1, np.float32)
        self.langs: list[str] = []
        self.by_lang = np.zeros((2 * ROWS, 0), np.float32)
        self.shift = np.zeros(1, np.float32)

    def train(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 6) -> None:
        """Fits texts, none of them empty, to their labels, of which there are both."""
        rng = np.random.default_rng(seed)
        params = {"c": self.c, "v": self.v, "b": self.b} | self.w
        adam = {k: _Adam(p, RATE) for k, p in params.items()}
        embedding = _Adam(self.e, EMBEDDING_RATE, 0.99)
        by = [np.flatnonzero(y == k) for k in (0, 1)]
        most = max(map(len, by))
        for _ in range(EPOCHS):
            order = np.concatenate([np.resize(rng.permutation(i), most) for i in by])
            rng.shuffle(order)
            for low in range(0, len(order), MINIBATCH):
                some = order[low : low + MINIBATCH]
                grads, at, g = self._gradients([texts[i] for i in some], y[some], rng)
                for k, x in grads.items():
                    adam[k].move(x)
                one, number = np.unique(at, return_inverse=True)
                sums = np.zeros((len(one), DIM), np.float32)
                np.add.at(sums, number, g)
                embedding.move(sums, one)

    def _gradients(self, texts: list[np.ndarray], y: np.ndarray, rng: np.random.Generator):
        """Those of the parameters, and of embedding rows."""
        rows, n = np.concatenate(texts), np.array([len(t) for t in texts])
        doc = np.repeat(np.arange(len(n)), n)
        x = self.e[rows[:, 0]] + self.e[rows[:, 1]]
        best, top = [], []
        for w in WIDTHS:
            acts = x @ self.w[w][0]
            for j in range(1, min(w, len(x))):
                acts[:-j] += (x[j:] @ self.w[w][j]) * (doc[j:] == doc[:-j])[:, None]
            best.append(np.maximum.reduceat(acts, np.cumsum(n) - n, axis=0))
            place, f = np.nonzero(acts == best[-1][doc])
            top.append(np.zeros((len(n), FILTERS), np.int64))
            top[-1][doc[place], f] = place
        pre = np.concatenate(best, axis=1) + self.c
        keep = ((rng.random(pre.shape) >= DROPOUT) / (1 - DROPOUT)).astype(np.float32)
        hidden = np.maximum(pre, 0) * keep
        off = ((1 / (1 + np.exp(-np.clip(hidden @ self.v + self.b[0], -30, 30))) - y) / len(n)).astype(np.float32)
        back = off[:, None] * self.v * keep * (pre > 0)
        grads: dict = {"v": hidden.T @ off, "b": np.array([off.sum()]), "c": back.sum(axis=0)}
        at, g = [np.zeros(0, np.int32)], [np.zeros((0, DIM), np.float32)]
        for k, w in enumerate(WIDTHS):
            mine = back[:, k * FILTERS : (k + 1) * FILTERS]
            grads[w] = np.zeros_like(self.w[w])
            for j in range(w):
                place = np.minimum(top[k] + j, len(doc) - 1)
                i, f = np.nonzero((top[k] + j < len(doc)) & (doc[place] == np.arange(len(n))[:, None]) & (mine != 0))
                place, d = place[i, f], mine[i, f][:, None]
                np.add.at(grads[w][j].T, f, x[place] * d)
                at += [rows[place, 0], rows[place, 1]]
                g += [self.w[w][j][:, f].T * d] * 2
        return grads, np.concatenate(at), np.concatenate(g)

    def tables(self) -> list[np.ndarray]:
        return [self.e @ self.w[w][j] for w in WIDTHS for j in range(w)]

    def scorer(self) -> Scorer:
        return Scorer(self.tables(), self.c, self.v, float(self.b[0]), self.by_lang if self.langs else None, self.shift)


class Scorer:
    """What scoring needs of a model; of a fixed size but for the languages."""

    def __init__(self, tables, c, v, b, by_lang, shift):
        self.tables, self.c, self.v, self.b, self.by_lang, self.shift = tables, c, v, b, by_lang, shift

    def language(self, rows: np.ndarray) -> int:
        if not len(rows) or self.by_lang is None:
            return 0
        return int((self.by_lang[rows[:, 0]].sum(axis=0) + self.by_lang[rows[:, 1]].sum(axis=0)).argmax())

    def logit(self, rows: np.ndarray) -> float:
        """Of one text, by the precomputed rows. A place where a filter reaches beyond
        the text's end takes what is there; a text without words has zeros."""
        n, k, out = len(rows), 0, []
        for w in WIDTHS:
            if n:
                total = self.tables[k][rows[:, 0]] + self.tables[k][rows[:, 1]]
                for j in range(1, min(w, n)):
                    total[:-j] += self.tables[k + j][rows[j:, 0]] + self.tables[k + j][rows[j:, 1]]
            out.append(total.max(axis=0) if n else np.zeros(FILTERS, np.float32))
            k += w
        return float(np.maximum(np.concatenate(out) + self.c, 0) @ self.v + self.b)


def _texts(docs: DataFrame, names: list[str], text_col: str) -> DataFrame:
    """The named columns and the rows of each text's words, as bytes."""

    def batches(it):
        for batch in slices(it, "text"):
            h, begin, head = scan.words(batch.column("text"), scan.ALNUM, prefix=HEAD)
            r = rows_of(h, head)
            words = pa.array([r[a:b].tobytes() for a, b in zip(begin, begin[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], words], names=[*names, "words"])

    ddl = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names) + ", words binary"
    return docs.select(*names, F.col(text_col).alias("text")).mapInArrow(batches, ddl)


def _share(rows: DataFrame, label_col: str, sample: int) -> Column:
    """Of 2^20 parts, those of each label that make about ``sample`` rows."""
    sizes = {r[0]: r[1] for r in rows.groupBy((F.col(label_col) == 1).alias("toxic")).count().collect()}
    part = {k: int((1 << 20) * min(1.0, sample / max(1, sizes.get(k, 0)))) for k in (True, False)}
    return F.when(F.col(label_col) == 1, part[True]).otherwise(part[False])


def sampled(labels: DataFrame, label_col: str, key: Column, *, sample: int = SAMPLE) -> DataFrame:
    """About ``sample`` rows of each label, those with the smallest hashes of ``key``:
    so few that they can be broadcast to the documents."""
    rows = labels.where(F.col(label_col).isNotNull())
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < _share(rows, label_col, sample))


def fit(docs: DataFrame, label_col: str, text_col: str = "text", lang_col: str | None = "lang", key: Column | None = None, *, sample: int = SAMPLE, longest: int = LONGEST, threshold: float = THRESHOLD) -> Model:
    """A model fitted on about ``sample`` rows of each label, those with the smallest
    hashes of ``key``, less texts of over ``longest`` bytes, so that what comes to the
    driver is bounded; a fifth of them is kept out to calibrate thresholds. Rows with a
    null label and texts without words are not used. Without both labels the model
    scores everything alike."""
    key = key if key is not None else F.col(text_col)
    rows = sampled(docs, label_col, key, sample=sample).where(F.octet_length(text_col) <= longest)
    rows = rows.select(F.xxhash64(key).alias("_h"), (F.col(label_col) == 1).cast("int").alias("_y"), (F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")).alias("_lang"), F.col(text_col).alias("_words"))
    got = sorted((r for r in _texts(rows, ["_h", "_y", "_lang"], "_words").collect() if len(r["words"])), key=lambda r: (r["_h"], r["_y"], bytes(r["words"])))
    texts = [np.frombuffer(bytes(r["words"]), np.int32).reshape(-1, 2) for r in got]
    y = np.array([r["_y"] for r in got], np.float32)
    out = np.arange(len(got)) % 5 == 4
    fit_on = np.flatnonzero(~out)
    model = Model()
    if not len(fit_on) or y[fit_on].min() == y[fit_on].max():
        model.v[:] = 0
        return model
    model.train([texts[i] for i in fit_on], y[fit_on])
    langs = [r["_lang"] for r in got]
    model.langs = sorted({x for x in langs if x is not None})
    counts = np.full((2 * ROWS, len(model.langs)), 0.1)
    for i in fit_on:
        if langs[i] is not None:
            np.add.at(counts[:, model.langs.index(langs[i])], texts[i].ravel(), 1)
    model.by_lang = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    scorer = model.scorer()
    z = np.array([scorer.logit(t) for t in texts])
    guess = np.array([scorer.language(t) for t in texts])
    model.shift = np.zeros(max(1, len(model.langs)), np.float32)
    everywhere = _best(z[out], y[out])
    for k in range(len(model.shift)):
        mine = out & (guess == k)
        enough = min((y[mine] == 1).sum(), (y[mine] == 0).sum()) >= 10
        model.shift[k] = np.log(threshold / (1 - threshold)) - (_best(z[mine], y[mine]) if enough else everywhere)
    return model


def _best(z: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the largest F1, in the middle of the gap it lies in."""
    order = np.argsort(-z, kind="stable")
    z, y = z[order], y[order]
    if not len(z) or y.sum() == 0:
        return 0.0
    true = np.cumsum(y)
    f1 = 2 * true / (np.arange(1, len(z) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = -1
    k = int(f1.argmax())
    return float((z[k] + z[k + 1]) / 2 if k + 1 < len(z) else z[k] - 0.5)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1, of the whole text), predicted (1
    from ``threshold`` on). Null, empty and wordless texts have the score that no
    evidence gives. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(model.scorer())  # fixed size: tables of ROWS rows

    def batches(it):
        m = shared.value
        for batch in slices(it, "text"):
            h, begin, head = scan.words(batch.column("text"), scan.ALNUM, prefix=HEAD)
            out = []
            for a, b in zip(begin, begin[1:]):
                r = rows_of(h[a:b], head[a:b])
                z = m.logit(r) + float(m.shift[m.language(r)])
                out.append(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))
            s = np.array(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("text")).mapInArrow(batches, f"`{id_col}` {kind}, score double, predicted int")

"""Packing and chat queries on a given table, and the classifier's arithmetic."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np

from filmstrip.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def test_packing_query(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    want = set()
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array([*t.encode(d.text or "", add_special_tokens=False).ids, 1], "<u4")
        want |= {(d.doc_id, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))}
    got = queries.op2_packing(spark, SF).collect()
    assert {(g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got} == want and len(got) == len(want)
    by = defaultdict(list)
    for g in got:
        by[g.sequence_id].append((g.offset, g.length))
    for parts in map(sorted, by.values()):
        assert [a for a, _ in parts] == np.r_[0, np.cumsum([n for _, n in parts])[:-1]].tolist() and sum(n for _, n in parts) <= 4096
    assert len(by) <= -(-sum(g.length for g in got) // 4096) + 1


def test_chat_query(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role or "", r.text or ""))
    turns[-1] = [("user", queries.HOSTILE), ("assistant", queries.HOSTILE)]
    got = {g.conv_id: g for g in queries.op3_chat(spark, SF).collect()}
    assert set(got) == set(turns)
    for c, said in turns.items():
        loss = "".join(t for r, t in said if r == "assistant")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(said), digest("".join(f"{r}\n{t}\n" for r, t in said)), len(loss), digest(loss))
        assert g.formatted_chars >= sum(len(r) + len(t) for r, t in said)


def model(seed=3):
    m = toxicity.Model(seed)
    r = np.random.default_rng(seed)
    for x in (m.e, m.c, m.v, *m.w.values()):
        x += r.standard_normal(x.shape).astype(np.float32) * 0.2
    return m, [r.integers(0, toxicity.ROWS, (n, 2)) + np.array([0, toxicity.ROWS]) for n in (1, 2, 3, 7, 30)]


def plain_logit(m, rows, e=None, w=None, c=None, v=None, b=None):
    """A convolution written out: places, filters, widths, the largest, a weighted sum."""
    e, w, c, v, b = (x if x is not None else y for x, y in ((e, m.e), (w, m.w), (c, m.c), (v, m.v), (b, m.b)))
    x = [e[i].astype(float) + e[j].astype(float) for i, j in rows]
    out = []
    for width in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            out.append(max(sum(float(x[p + j] @ w[width][j][:, f].astype(float)) for j in range(width) if p + j < len(x)) for p in range(len(x))))
    return float(np.maximum(np.array(out) + c, 0) @ v + b[0])


def test_scores_are_a_plain_convolution():
    m, texts = model()
    scorer = m.scorer()
    for t in texts:
        assert abs(scorer.logit(t) - plain_logit(m, t)) < 1e-3 * max(1, abs(plain_logit(m, t)))


def test_gradients_are_differences(monkeypatch):
    """Of the mean logistic loss, without dropout, in single directions."""
    monkeypatch.setattr(toxicity, "DROPOUT", 0.0)
    m, texts = model()
    y = np.array([1, 0, 1, 0, 1])
    grads, at, g = m._gradients(texts, y, np.random.default_rng(0))

    def loss(**changed):
        z = np.array([plain_logit(m, t, **changed) for t in texts])
        return float(np.mean(np.logaddexp(0, z) - y * z))

    def slope(name, array, index, key=None):
        out = []
        for step in (1e-3, -1e-3):
            x = array.astype(float).copy()
            x[index] += step
            out.append(loss(**{name: {**m.w, key: x} if key else x}))
        return (out[0] - out[1]) / 2e-3

    r = np.random.default_rng(1)
    for k in map(int, r.choice(len(m.c), 6, replace=False)):
        assert abs(slope("c", m.c, k) - grads["c"][k]) < 2e-3
        assert abs(slope("v", m.v, k) - grads["v"][k]) < 2e-3
    assert abs(slope("b", m.b, 0) - grads["b"][0]) < 1e-3
    for width in toxicity.WIDTHS:
        top = np.unravel_index(np.abs(grads[width]).argmax(), grads[width].shape)
        assert abs(slope("w", m.w[width], top, width) - grads[width][top]) < 2e-3 + 0.02 * abs(grads[width][top])
    for row in map(int, r.choice(at, 4)):
        mine = g[at == row].sum(axis=0)
        d = int(np.abs(mine).argmax())
        assert abs(slope("e", m.e, (row, d)) - mine[d]) < 2e-3 + 0.02 * abs(mine[d])

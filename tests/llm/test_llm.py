"""The operators against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmstrip.llm import chat, decontam, langid, licenses, minhash, packing, queries, scan, suffixes, toxicity, vectors, warc
from filmstrip.llm.components import components

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def text(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edge_docs():
    base = text(120, 1)
    return [(1, base), (2, base), (3, base + " tail"), (4, None), (5, ""), (6, " \n\t"), (7, "one"), (7, "one"), (8, "One"), (9, text(20_000, 2)), (None, base), (10, "a" * 300), (11, "a" * 280), (12, "é" * 60), (13, base[:200] + text(60, 4))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_docs(), DOC).withColumns({"id": F.lit(1), "n": F.lit("x"), "block": F.lit(2), "band": F.lit(3), "score": F.lit(0)}).repartition(3)


def brute_near(rows, width, percent=80):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = set(zip(*[w[j:] for j in range(width)])) if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        u, v = sets[a], sets[b]
        if u and v and 100 * len(u & v) >= percent * len(u | v):
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_words_match_a_plain_split():
    import pyarrow as pa

    texts = [t for _, t in edge_docs()] + ["A-b c_D,1", "x" * (scan.STEP + 5) + " y", "Ünï cödé"]
    for table, pattern in ((scan.NOT_SPACE, r"[^\x20\x09-\x0D]+"), (scan.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        h, begin, a, b = scan.words(pa.array(texts), table, places=True)
        data = scan.LOWER[scan.bytes_of(pa.array(texts))[0]].tobytes()
        names = {}
        for k, t in enumerate(texts):
            got = [data[x:y].decode() for x, y in zip(a[begin[k] : begin[k + 1]], b[begin[k] : begin[k + 1]])]
            assert got == re.findall(pattern, (t or "").translate(LOWER))
            for w, x in zip(got, h[begin[k] : begin[k + 1]].tolist()):
                assert names.setdefault(w, x) == x
        assert len(set(names.values())) == len(names)


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(None, 3), (7, 7)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None:
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {g.id: g.component for g in got} == {x: root(x) for x in list(up)} and len(got) == len(up)


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, docs, width):
    got = minhash.near_duplicates(docs, width=width).collect()
    assert len(got) == len(edge_docs())
    want = brute_near([d for d in edge_docs() if d[0] is not None], width)
    for g in got:
        if g.doc_id is None:
            assert g.component_id is None and g.kept
        else:
            assert (g.n_shingles, g.component_id) == want[g.doc_id] and g.kept == (g.doc_id == g.component_id)


def test_near_duplicates_of_one_family(spark):
    """Near copies of one text, of which about half of all pairs are links."""
    base = text(90, 5).split()
    rows = []
    for i in range(120):
        r, w = random.Random(i), list(base)
        for _ in range(r.randint(1, 9)):
            w[r.randrange(len(w))] = f"edit{r.randrange(40)}"
        rows.append((i, " ".join(w)))
    got = {g.doc_id: g.component_id for g in minhash.near_duplicates(spark.createDataFrame(rows, DOC), width=2).collect()}
    assert got == {i: c for i, (_, c) in brute_near(rows, 2).items()}


def test_estimates_are_corrected():
    n = 4000
    for j in (0.0, 0.5, 0.8, 1.0):
        both = int(2 * n * j / (1 + j))
        r = np.random.default_rng(int(j * 10))
        x = r.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
        a, b = np.sort(x[:n]), np.sort(x[n - both : 2 * n - both])
        e, _ = minhash.estimate(minhash.registers(a)[None], minhash.registers(b)[None], np.array([n]), np.array([n]))
        assert abs(e[0] - j) < 0.13


def test_one_query_on_given_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {g.doc_id: (g.n_shingles, g.component_id) for g in queries.op7_minhash(spark, SF).collect()}
    assert got == brute_near(rows, 2)


def brute_cut(rows, window=50):
    first, out = {}, defaultdict(list)
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first.setdefault(b[i : i + window], d) < d:
                gone[i : i + window] = b"\1" * window
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d].append((bytes(x for x, g in zip(b, gone) if not g), len(b), sum(gone), runs))
    return {d: sorted(v) for d, v in out.items()}


@pytest.mark.parametrize("options", [{}, {"block_bytes": 20_000, "heavy": 2, "hot": 3}, {"block_bytes": 5_000}])
def test_repeats(spark, docs, options):
    got = defaultdict(list)
    for g in suffixes.without_repeats(docs, **options).collect():
        got[g.doc_id].append((bytes(g.kept), g.n_bytes, g.n_removed, g.n_spans))
    assert [x[2] for x in got.pop(None)] == [0]
    assert {d: sorted(v) for d, v in got.items()} == brute_cut(edge_docs())


def test_repeats_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {g.doc_id: tuple(g)[1:] for g in queries.op6_suffixes(spark, SF).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()}
    assert got == {d: (*v[0][1:], hashlib.sha256(v[0][0]).hexdigest()) for d, v in brute_cut(rows).items()}


def test_warc_payloads_are_shuffled_small():
    import pyarrow as pa
    import pyarrow.parquet as pq

    html = [x or "" for x in pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist()] + ["", "\u00e9\U0001f600"]
    phrases = b"".join(x[:2000].encode() for x in html[:16])[-(1 << 15) :]
    for shared in (phrases, b""):
        (squeezed,) = warc._squeezed(shared)([pa.RecordBatch.from_pydict({"html": html})])
        lengths = pa.array([len(x.encode()) for x in html])
        (back,) = warc._texts(shared)([pa.RecordBatch.from_arrays([pa.array(["h"] * len(html)), lengths, squeezed.column("html")], names=["head", "stored", "html"])])
        assert back.column("value").to_pylist() == ["h" + warc.BREAK + x for x in html]
        if shared:
            alone = sum(len(pa.compress(x.encode(), codec="zstd", asbytes=True)) for x in html)
            assert sum(map(len, squeezed.column("html").to_pylist())) < 0.9 * alone


def test_suffix_buckets_hold_about_as_much_each():
    import pyarrow as pa

    r = np.random.default_rng(3)
    texts = ["".join(map(chr, r.integers(97, 123, 3000))) for _ in range(60)]
    texts += [t[:2000] + "x" + t[2000:] for t in texts[::2]]
    data = [x.encode() for x in texts]
    offsets = np.cumsum([0, *map(len, data)])
    rows = pa.table([[0], [np.arange(len(data)).tobytes()], [offsets.tobytes()], [suffixes.squeezed(np.frombuffer(b"".join(data), np.uint8))], [b""]], schema=suffixes.BUNDLES)
    parts = suffixes._announce(24, 40, suffixes.HEAVY)([pa.scalar(0)], rows)
    announced = [len(x) // 8 for x in parts.column("hashes").to_pylist()]
    sent = suffixes._send(24, 40)([pa.scalar(0)], rows, suffixes._table(suffixes.SHARED, [])).to_pylist()
    strings = [len(x["number"]) // 4 for x in sent if x["bucket"] >= 0]
    for sizes in (announced, strings):
        assert len(sizes) == 24 and max(sizes) < 2 * np.mean(sizes)


def test_common_prefixes_of_suffixes():
    r = np.random.default_rng(5)
    text = np.repeat(r.integers(0, 256, (1, suffixes.WIDE), dtype=np.uint8), 120, axis=0)
    text[np.arange(120), r.integers(0, suffixes.WIDE, 120)] ^= 1
    row, place, other = np.arange(120), np.full(120, 7), np.roll(np.arange(120), 1)
    other[0] = -1
    cut = [text[i, 7 : 7 + suffixes.WINDOW] for i in range(120)]
    want = [0] + [int(np.argmax(np.r_[cut[i] != cut[i - 1], True])) for i in range(1, 120)]
    assert suffixes._common(text, row, place, other).tolist() == want


def test_window_ranks_are_suffix_order():
    r = np.random.default_rng(0)
    rows = r.integers(97, 99, (40, suffixes.WIDE), dtype=np.uint8)
    rows[20:, 10:70] = rows[:20, 5:65]
    rank = suffixes.window_ranks(rows)
    flat = sorted((rows[i, j : j + suffixes.WINDOW].tobytes(), int(rank[i, j])) for i in range(40) for j in range(suffixes.GRAMS))
    ranks = [x for _, x in flat]
    assert ranks == sorted(ranks) and all((a[0] == b[0]) == (a[1] == b[1]) for a, b in zip(flat, flat[1:]))


def test_vectors(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, 16))
    rows, i = [], 0
    for b in base:
        for _ in range(r.integers(1, 6)):
            rows.append((int(i), [float(np.float32(x)) for x in b + r.standard_normal(16) * 0.15], int(i % 2)))
            i += 1
    rows += [(i + k, list(rows[0][1]), 0) for k in range(30)]
    n = len(rows)
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [None] + [1.0] * 15, 0), (n + 5, rows[0][1], None), (n + 6, [1.0] * 3, 0)]
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in vectors.near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int"), rows_per_block=8).collect()}
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = np.array([c for *_, c in rows])
    link = (x @ x.T >= 0.93) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    comp = np.arange(n)
    while (new := np.array([min([comp[k], *comp[link[k]]]) for k in range(n)])).tolist() != comp.tolist():
        comp = new
    want = {k: (int(link[k].sum()), int(comp[k]), bool(comp[k] == k)) for k in range(n)} | {k: (0, k, True) for k, *_ in odd}
    assert got == want
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_vectors_of_several_lengths(spark):
    r = np.random.default_rng(5)
    sizes = [16] * 40 + [8] * 12 + [3] * 4
    rows = []
    for i, n in enumerate(sizes):
        v = [float(x) for x in r.standard_normal(n).astype(np.float32)]
        rows += [(2 * i, v, 0), (2 * i + 1, v, 0)]
    got = {g.vec_id: (g.n_links, g.component_id) for g in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows}
    for i in x:
        assert got[i][0] == sum(j != i and len(x[j]) == len(x[i]) and x[j] @ x[i] >= 0.93 for j in x) and got[i][1] <= i - i % 2
    assert len(got) == len(rows)


def test_archives(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    long = "x" * 120 + "é"
    pages = [(1, "u", long), (2, "u\r\nv", long), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", fake * 3), (7, "u", "\r\n\r\n" * 5), (8, "u", "y" * 40_000), (9, "u", "y" * 40_000), (1, "u", long), (10, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "path": F.lit(2)})
    path = warc.scratch(spark, "warc-test")
    warc.write_archives(df.coalesce(1), path)
    for size in (1 << 20, 4096, 700):
        got = warc.resolved(warc.read_archives(spark, path, range_bytes=size)).collect()
        assert sorted((int(g.id), bytes(g.payload).decode()) for g in got) == sorted((i, h or "") for i, _, h in pages)
        assert {(int(g.id), g.refers_to) for g in got if g.type == "revisit"} == {(2, "1"), (9, "8")}
        assert all(g.digest == hashlib.sha256(bytes(g.payload)).hexdigest() and g.payload_length == len(g.payload) for g in got)


def test_archives_with_long_headers(spark):
    fake = "WARC/1.1\r\nX: y\r\n" * 3000 + "Content-Length: 7\r\n" + "z" * 90_000
    pages = [(1, "u", "a" * 50_000), (2, "v" * 200_000, "b" * 30), (3, "u", "c" * 50_000), (4, "é" * 100_000, None), (5, "w" * 65_400, "d" * 300), (6, "x" * 200_000, fake), (7, "u", "e"), (8, "y" * 1_000_000, "c" * 50_000)]
    path = warc.scratch(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    for size in (8 << 20, 100_000, 7_000):
        got = warc.resolved(warc.read_archives(spark, path, range_bytes=size)).collect()
        assert sorted((int(g.id), g.url, bytes(g.payload).decode()) for g in got) == [(i, u, h or "") for i, u, h in pages]


def test_archives_query(spark):
    first, want = {}, {}
    for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect():
        b = (r.html or "").encode()
        d = hashlib.sha256(b).hexdigest()
        f = first.setdefault(d, r.page_id) if len(b) >= 100 else r.page_id
        want[r.page_id] = (len(b), d, "response" if f == r.page_id else "revisit", None if f == r.page_id else f)
    assert {g.page_id: tuple(g)[1:] for g in queries.op1_warc(spark, SF).collect()} == want


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    got = packing.pack_documents(docs, queries.tokenizer_path()).collect()
    want = []
    for d, x in edge_docs():
        ids = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for k, at in enumerate(range(0, len(ids), 4096))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(g)[:5]) for g in got)
    by = defaultdict(list)
    for g in got:
        by[g.sequence_id].append((g.offset, g.length))
    for parts in by.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 4096
    assert len(by) <= -(-sum(g.length for g in got) // 4096) + 1


def test_ids_of_hard_texts():
    cache = packing.WordCache(queries.tokenizer_path())
    for x in ["<|endoftext|> a B's Σας İstanbul é é ½ x2y don't 'S ", "  \t\r a\x0bb c　d", " ", "", "a\nb", "Ǆ ﬁ 12,345.6 $$$ …", "日本語 テスト", "🙂🙃 ok", "Å!"]:
        assert np.frombuffer(cache.encode(x), "<u4").tolist() == cache.tokenizer.encode(x, add_special_tokens=False).ids


def test_pack_is_close_to_the_bound():
    r = np.random.default_rng(2)
    lengths = np.minimum(r.lognormal(6.5, 1.1, 5000).astype(int) + 1, 4096)
    s, at = packing.pack(lengths)
    assert s.max() + 1 <= -(-lengths.sum() // 4096) * 1.01 + 1
    used = np.bincount(s, lengths)
    assert used.max() <= 4096
    for k in range(0, s.max() + 1, 97):
        i = np.flatnonzero(s == k)
        i = i[np.argsort(at[i])]
        assert at[i].tolist() == np.r_[0, np.cumsum(lengths[i])[:-1]].tolist()


def within_budget(windows, budget=chat.BUDGET):
    """Only a window of one new turn, with the system turn, may be larger."""
    for w in windows.collect():
        turns = w.formatted.split(chat.START)[1:]
        assert w.n_tokens <= budget or (len(turns) - w.n_repeated == 1 and all(t.startswith("system") for t in turns[:-1]))


def test_chat_budget(spark):
    """Given conversations, turns of all sizes, and turns beyond the budget."""
    within_budget(chat.windows(spark.read.parquet(f"{SF}/conversations.parquet")))
    r = random.Random(3)
    rows = [(c, k, "system" if k == c % 3 else r.choice(["user", "assistant"]), text(r.choice([3, 30, 150, 300, 700, 1500]), 90 * c + k)) for c in range(12) for k in range(40)]
    for budget in (64, 400, 1024):
        windows = chat.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=budget)
        within_budget(windows, budget)
        assert windows.agg(F.sum(F.size("targets"))).first()[0] == sum(r[2] == "assistant" for r in rows)


def test_chat(spark):
    long = [(5, k, "user" if k % 2 else "assistant", text(200, k)) for k in range(30)]
    rows = long + [(1, 0, "system", "be <|im_start|>good"), (1, 1, "user", "a<^|b <|c"), (1, 2, "assistant", "x\ny<|im_end|>\n"), (2, 0, None, None), (2, 1, "assistant", ""), (3, 0, "we\nird<|n", "t"), (3, 1, "assistant", "same"), (3, 1, "assistant", "same"), (None, None, "assistant", "é" * 5000), (-1, 0, "user", queries.HOSTILE), (-1, 1, "assistant", queries.HOSTILE)]
    rows += [(6, 0, "system", "sys"), *[(6, k, "assistant" if k % 2 == 0 else "user", text(90, 50 + k)) for k in range(1, 40)]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"window": F.lit(1), "n": F.lit(2)})
    windows = chat.windows(df)
    got = {g.conv_id: g for g in chat.digests(windows).collect()}
    by = defaultdict(list)
    for c, k, role, t in rows:
        by[c].append((-1 if k is None else k, role or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()), c
    six = windows.where("conv_id = 6").orderBy("window").collect()
    assert len(six) > 3 and all(w.formatted.startswith("<|im_start|>system\nsys") for w in six)
    assert all(1 <= w.n_repeated <= 1 + chat.HISTORY for w in six[1:]) and any(w.n_repeated == 1 + chat.HISTORY for w in six)
    within_budget(windows)
    assert "Python" not in windows._jdf.queryExecution().executedPlan().toString()


def test_languages(spark):
    found = queries.op4_langid(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    r = found.join(truth, "doc_id").where("held_out and lang is not null").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r >= 0.95


def test_language_edges(spark, docs):
    path = queries.tokenizer_path(queries.PIECES)
    train = spark.createDataFrame([("the cat and the dog in the house",  "en"), ("der hund und die katze im haus", "de"), (None, "en"), ("x", None)], "text string, lang string")
    langs, p = langid.fit(train, path)
    assert langs == ["de", "en"] and np.allclose(p.sum(axis=0), 1)
    got = {g.doc_id: g for g in langid.identify(docs, langs, p, path).collect()}
    assert [got[i].lang_pred for i in (4, 5, 6)] == ["und"] * 3 and all(0 <= g.score <= 1 for g in got.values())
    few = spark.createDataFrame([(1, "12 34 …"), (2, "the dog"), (3, "der hund"), (4, "w" * 100)], DOC)
    assert [g.lang_pred for g in langid.identify(few, langs, p, path).orderBy("doc_id").collect()][:3] == ["und", "en", "de"]
    assert langid.identify(few, [], np.zeros((0, 0)), path).where("lang_pred = 'und' and score = 0").count() == 4


def test_forward_sums_all_segmentations():
    v = langid.Vocabulary(queries.tokenizer_path(queries.PIECES))
    p = np.random.default_rng(0).random((v.size, 2))
    p /= p.sum(axis=0)
    words = [b"the", b"under", "été".encode()]

    def plain(w, k):
        def number(x):
            h = langid._substrings(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))
            return int(v.find(h)[0])

        a = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            a[e] = sum(a[s] * p[n, k] for s in range(e) if (n := number(w[s:e])) >= 0)
        return a[-1]

    assert np.allclose(langid.forward(words, v, p), [[np.log(plain(w, k)) for k in range(2)] for w in words])


def test_licenses(spark, docs):
    mit = licenses.TEMPLATES["mit"]
    rows = edge_docs() + [(20, "GNU General\npublic-LICENSE, x gnu general public license"), (21, "see " + mit + " end"), (22, "the mit licence"), (23, "cc by cc by"), (24, " ".join(mit.split()[:40]))]
    got = {g.doc_id: g for g in licenses.license_scan(spark.createDataFrame(rows, DOC)).collect()}
    assert (got[20].n_base, got[20].first_word, got[20].last_word, got[20].base_labels, got[20].score) == (2, 0, 5, "gpl", 1.0)
    assert "mit" in got[21].labels and got[21].spans and (got[22].n_base, got[22].labels) == (0, "")
    assert (got[23].n_base, got[23].first_word, got[23].last_word) == (2, 0, 2) and got[4].n_words == 0
    automaton = licenses.Automaton([licenses.words(t) for t in licenses.TEMPLATES.values()])
    grams = {tuple(w[i:j]) for w in map(licenses.words, licenses.TEMPLATES.values()) for i in range(len(w)) for j in range(i + 1, min(len(w), i + 12) + 1)}
    tokens = licenses.words(mit)[10:30] + ["zzz"] + licenses.words(licenses.TEMPLATES["bsd-2-clause"])[5:14] + ["the", "software", "is"]
    for i, (n, _) in enumerate(automaton.statistics(tokens)):
        best = max((k for k in range(1, 12) if k <= i + 1 and tuple(tokens[i + 1 - k : i + 1]) in grams), default=0)
        assert min(n, 11) == best


def brute_licenses(rows):
    """The base columns of op5 by its contract."""
    out = {}
    for d, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places = sorted((i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split())
        out[d] = (len(w), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))
    return out


def test_licenses_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {g.doc_id: g for g in queries.op5_licenses(spark, SF).collect()}
    want = brute_licenses(rows)
    assert {d: (g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for d, g in got.items()} == want and any(w[1] for w in want.values())
    assert all(0 <= g.score <= 1 and set(g.base_labels.split(",")) <= set(g.labels.split(",")) | {""} for g in got.values())


def test_licenses_by_plain_matching(spark):
    """Spans against matching statistics by comparing every run of words."""
    r, rows = random.Random(4), []
    names = sorted(licenses.TEMPLATES)
    for i in range(60):
        w = licenses.words(licenses.TEMPLATES[names[i % len(names)]])
        a = r.randrange(len(w) // 2)
        part = [x for x in w[a : a + r.randint(len(w) // 3, len(w))] if r.random() > 0.03]
        rows.append((i, " ".join(text(r.randint(0, 30), i).split() + part + text(20, 99 + i).split())))
    odd = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n_words int, labels string, spans int")
    got = {g.doc_id: g for g in licenses.license_scan(odd).collect()}
    for i, t in rows:
        w = licenses.words(t)
        found = []
        for k, template in enumerate(map(licenses.words, licenses.TEMPLATES.values())):
            for f in range(len(w)):
                for p in (p for p, x in enumerate(template) if x == w[f]):
                    n = 0
                    while f + n < len(w) and p + n < len(template) and w[f + n] == template[p + n]:
                        n += 1
                    found.append((k, p, f, n))
        longest = lambda f, n: not any(g <= f and f + n <= g + m and m > n for _, _, g, m in found)
        maximal = {x for x in found if x[3] >= licenses.LEAST and longest(x[2], x[3])}
        scanner = licenses._Scanner(licenses.TEMPLATES, licenses.PHRASES)
        spans = scanner.chains(sorted(maximal))
        assert {scanner.labels[x[0]] for x in spans} == {x.label for x in got[i].spans}


def best_cover(matches, gap):
    """The best chain that ends at each match, over all earlier matches."""
    done = {}
    for f, t, n in sorted(matches):
        done[f, t, n] = max([n, *(c + min(n, t + n - v - m, f + n - g - m) for (g, v, m), c in done.items() if g + m < f + n and v + m < t + n and f <= g + m + gap)])
    return max(done.values(), default=0)


def test_no_license_is_lost_between_junk():
    """Whole templates with an unknown word after every n-th one: a chain in order covers
    enough of each, so each is found; and chains are the best there are."""
    import pyarrow as pa

    scanner = licenses._Scanner(licenses.TEMPLATES, licenses.PHRASES)
    for k, (label, template) in enumerate(licenses.TEMPLATES.items()):
        w = licenses.words(template)
        for n in range(4, 16):
            for offset in range(0, n, 3):
                parts = [w[:offset], *(w[i : i + n] for i in range(offset, len(w), n))]
                t = " zzqx ".join(" ".join(x) for x in parts)
                h, _ = scan.words(pa.array([t]), scan.ALNUM)
                assert label in {scanner.labels[x[0]] for x in scanner.scan(h)[1]}, (label, n, offset)
    r = random.Random(2)
    for _ in range(300):
        matches = sorted({(r.randrange(60), r.randrange(40), r.randint(3, 9)) for _ in range(r.randint(1, 14))})
        stretches = list(licenses._stretches(matches))
        assert sorted(m for x in stretches for m in x) == matches
        for x in stretches:
            assert licenses._best_chain(x)[0] == best_cover(x, licenses.GAP)
        assert max(licenses._best_chain(x)[0] for x in stretches) == best_cover(matches, licenses.GAP)
    twice = "\n".join([" ".join(licenses.TEMPLATES["mit"].split()[9:])] * 3)  # adjacent copies are spans of their own
    h, _ = scan.words(pa.array([twice]), scan.ALNUM)
    spans = [x for x in scanner.scan(h)[1] if scanner.labels[x[0]] == "mit"]
    assert len(spans) == 3 and all(a[2] < b[1] for a, b in zip(spans, spans[1:]))


def test_short_licenses(spark):
    rows = [(1, "under copyleft terms"), (2, "see unlicense here"), (3, "public domain"), (4, "a b c d public"), (5, "copyleft copyleft")]
    scan_ = licenses.license_scan(spark.createDataFrame(rows, DOC), templates={"unlicense": "unlicense", "pd": "public domain", "long": "a b c d"}, phrases={"copyleft": "cl"})
    got = {g.doc_id: (g.n_base, g.first_word, g.base_labels, g.labels, g.score) for g in scan_.collect()}
    assert got == {1: (1, 1, "cl", "cl", 1.0), 2: (0, None, "", "unlicense", 1.0), 3: (0, None, "", "pd", 1.0), 4: (0, None, "", "long", 1.0), 5: (2, 0, "cl", "cl", 1.0)}


def test_decontamination(spark):
    item = text(40, 9).split()
    edited = list(item)
    edited[5], edited[20] = "other", "words"
    del edited[30]
    rows = [(1, text(300, 10) + " " + " ".join(item) + " " + text(100, 11)), (2, text(50, 12) + " " + " ".join(edited).upper().replace("É", "é")), (3, text(2000, 13)), (4, None), (5, ""), (6, " ".join(item[:12])), (7, "alpha beta gamma delta"), (8, " ".join(item)), (8, " ".join(item))]
    bench = [(1, " ".join(item)), (2, None), (3, ""), (4, "two words"), (5, "beta gamma delta"), (None, "beta gamma delta")]
    got = decontam.contaminated(spark.createDataFrame(rows, DOC), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((g.doc_id, g.item_id, g.first_word, g.n_words, g.distance) for g in got) == [(1, 1, 300, 40, 0), (2, 1, 50, 39, 3), (7, 5, 1, 3, 0), (8, 1, 0, 40, 0), (8, 1, 0, 40, 0)]
    assert decontam.contaminated(spark.createDataFrame(rows, DOC), spark.createDataFrame([], "item_id long, text string")).count() == 0


def edits(words, places, r, kinds):
    """``words`` with one edit each at ``places``."""
    out = list(words)
    for i in sorted(places, reverse=True):
        kind = r.choice(kinds)
        out[i : i + 1] = {"change": [f"new{r.randrange(10**9)}"], "drop": [], "add": [f"new{r.randrange(10**9)}", out[i]]}[kind]
    return out


def all_hits(items, rows):
    """Hits of an index, and those of the edit distance over whole rows."""
    import pyarrow as pa

    h, begin = scan.words(pa.array(rows), scan.ALNUM)
    index = decontam._Index(list(enumerate(items)))
    want = set()
    for k, item in enumerate(index.words):
        for r in range(len(rows)):
            d, a, b = decontam.edit_distance(item, h[begin[r] : begin[r + 1]])
            if d <= decontam.edits(len(item)):
                want.add((r, k))
    got = set(index.hits(h, begin))
    for r, k, first, n, d in got:
        plain = decontam.edit_distance(index.words[k], h[begin[r] + first : begin[r] + first + n])
        assert d <= decontam.edits(len(index.words[k])) and plain[0] == d
    return {g[:2] for g in got}, want


def full_budget(lengths, each, middle=False):
    """Items of all lengths, and rows with them after as many edits as they may have,
    anywhere or in the middle."""
    r, items, rows = random.Random(8), [], []
    for n in lengths:
        item = text(n, 7000 + n).split()
        items.append(" ".join(item))
        most = decontam.edits(n)
        where = range((n - most) // 2, (n - most) // 2 + most + 1) if middle else range(n)
        spread = [(2 * i + 1) * n // (2 * most) for i in range(most)]
        for t in range(each):
            found = edits(item, r.sample(where, most) if t else spread, r, ["change", "drop", "add"] if t % 4 == 3 else ["change"])
            rows.append(" ".join([text(r.randint(1, 12), r.random()), *found, text(r.randint(1, 12), r.random())]))
    return items, rows


@pytest.mark.parametrize("middle", [False, True])
def test_items_at_full_budget(middle):
    """Recall at the most edits that an item may have, by its length."""
    for n in [*range(5, 21), 25, 30, 40, 50, 60]:
        got, want = all_hits(*full_budget([n], 60, middle))
        assert got <= want and len(want) >= 60 and len(got) >= 0.95 * len(want)


def test_shortest_items():
    items, rows = ["alpha beta gamma", "alpha beta gamma delta"], ["x alpha beta gamma", "alpha beta x gamma delta", "alpha beta gamma delta", "", "alpha beta"]
    got, want = all_hits(items, rows)
    assert got == want == {(0, 0), (2, 0), (2, 1)}


def test_items_that_begin_before_their_row():
    item = [f"w{i}" for i in range(20)]
    cut = " ".join(item[4:])
    rows = [cut, "", None, "a", cut + " tail", "a b", "", " ", cut, "b", cut, " ".join(item[:16]), "", "c", cut]
    got, want = all_hits([" ".join(item)], rows)
    assert got == want and {g[0] for g in got} == {0, 4, 8, 10, 11, 14}


def test_spread_edits(spark):
    item = [f"w{i}" for i in range(15)]
    found = [f"x{i}" if i in (4, 7, 10) else w for i, w in enumerate(item)]
    got = decontam.contaminated(spark.createDataFrame([(1, "a b " + " ".join(found) + " c")], DOC), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [tuple(g) for g in got] == [(1, 1, 2, 15, 3)]


def test_edit_distance():
    r = np.random.default_rng(4)
    for _ in range(40):
        a, b = r.integers(0, 4, r.integers(1, 8)), r.integers(0, 4, r.integers(0, 12))

        def plain(x, y):
            row = list(range(len(y) + 1))
            for i, p in enumerate(x, 1):
                row = [i] + [0] * len(y) if False else _next(row, i, p, y)
            return row[-1]

        def _next(row, i, p, y):
            out = [i]
            for j, q in enumerate(y, 1):
                out.append(min(row[j - 1] + (p != q), row[j] + 1, out[-1] + 1))
            return out

        d, s, e = decontam.edit_distance(a.astype(np.uint64), b.astype(np.uint64))
        assert d == min(plain(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1)) == plain(a, b[s:e])


def test_decontamination_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = {(r.doc_id, b.item_id) for r in rows for b in bench if b.text in (r.text or "")}
    assert {(g.doc_id, g.item_id) for g in queries.op9_decontamination(spark, SF).collect()} >= want


def test_toxicity(spark):
    bad = ["vile", "rotten", "nasty"]
    rows = [(i, text(80, i) + (f" {bad[i % 3]} " + text(20, i + 9999) if i % 3 == 0 else ""), int(i % 3 == 0), "en" if i % 2 else "de") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string")
    model = toxicity.fit(df.where("doc_id < 400"), "toxic", key=F.col("doc_id"))
    got = toxicity.score(df, model).join(df, "doc_id").where("doc_id >= 400").collect()
    assert np.mean([g.predicted == g.toxic for g in got]) > 0.97
    edge = toxicity.score(spark.createDataFrame(edge_docs(), DOC), model).collect()
    assert len(edge) == len(edge_docs()) and all(0 <= g.score <= 1 for g in edge)
    assert toxicity.fit(df.where("toxic = 0"), "toxic").v.sum() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert minhash.near_duplicates(none).count() == 0
    assert suffixes.without_repeats(none).count() == 0
    assert packing.pack_documents(none, queries.tokenizer_path()).count() == 0
    assert licenses.license_scan(none).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.digests(chat.windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_token_ids_of_every_code_point():
    """Planes 4 to 13, 15 and 16 hold no assigned characters but private ones."""
    cache = packing.WordCache(queries.tokenizer_path())
    points = [chr(i) for i in [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE0200), 0x50000, 0xF0000, 0x10FFFF]]
    for low in range(0, len(points), 40_000):
        texts = [f"a{x}b" for x in points[low : low + 40_000]]
        want = cache.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        assert [t for t, w in zip(texts, want) if cache.encode(t) != np.array(w.ids, "<u4").tobytes()] == []


def test_configurations():
    """The knapsack against all ways to fill a sequence; the optimum near its bound."""
    sizes, counts = [2100, 1900, 1000, 600], [300, 500, 700, 900]
    found = packing.configurations(sizes, counts)
    used = np.zeros(4, int)
    for times, slots in found:
        assert sum(sizes[g] for g in slots) <= 4096
        used += times * np.bincount(slots, minlength=4)
    assert (used <= counts).all() and (counts - used).sum() <= 4 * 6 and sum(t for t, _ in found) <= 1.05 * np.dot(sizes, counts) / 4096
    r = np.random.default_rng(2)
    for _ in range(20):
        size, value = r.integers(5, 40, 4), r.random(4)
        best = max(a * value[0] + b * value[1] + c * value[2] + d * value[3] for a in range(21) for b in range(21) for c in range(21) for d in range(21) if a * size[0] + b * size[1] + c * size[2] + d * size[3] <= 100)
        got = packing.best_pattern(size, value, 100)
        assert got @ size <= 100 and abs(got @ value - best) < 1e-9


def test_vectors_copies_doubles_and_names(spark):
    """Many copies, numbers beyond single precision, repeated ids, clashing names."""
    r = np.random.default_rng(9)
    a, b, c = (r.standard_normal(8).tolist() for _ in range(3))
    rows = [(i, a, 0) for i in range(3000)] + [(4000, [x * 1e200 for x in b], 0), (4001, [x * 1e-200 for x in b], 0), (4002, [x + 1e-9 for x in b], 0), (5000, c, 0), (5000, b, 0), (5001, c, 0)]
    df = spark.createDataFrame([(*x, 1, 2, 3, "k") for x in rows], "vec_id long, embedding array<double>, label int, m int, h1 long, id long, node string")
    got = sorted((g.vec_id, g.n_links, g.component_id, g.kept) for g in vectors.near_vectors(df).collect())
    assert got[:3000] == [(i, 2999, 0, i == 0) for i in range(3000)]
    assert got[3000:] == [(4000, 3, 4000, True), (4001, 3, 4000, False), (4002, 3, 4000, False), (5000, 1, 5000, True), (5000, 3, 4000, False), (5001, 1, 5000, False)]


def test_archives_of_null_ids_and_broken_files(spark):
    pages = [(None, "u", "a" * 200), (1, None, "a" * 200), (2, "u", "a" * 200), (None, None, None)]
    path = warc.scratch(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path)
    got = warc.read_archives(spark, path).collect()
    assert sorted((str(g.id), g.type, str(g.refers_to)) for g in got) == [("1", "response", "None"), ("2", "revisit", "1"), ("None", "response", "None"), ("None", "response", "None")]
    import glob

    name = next(f for f in glob.glob(f"{path}/part-*") if Path(f).stat().st_size)
    data = Path(name).read_bytes()
    assert data.count(b"\r\nWARC-Date: ") == 4 and len(set(re.findall(rb"WARC-Record-ID: <urn:uuid:[0-9a-f-]{36}>", data))) == 4
    for cut in (len(data) - 2, len(data) - 30, len(data) - 190):
        broken = warc.scratch(spark, "warc-test")
        Path(broken).mkdir()
        Path(broken, "x.warc").write_bytes(data[:cut])
        with pytest.raises(ValueError, match="x.warc"):
            warc.read_archives(spark, broken)
        assert 1 <= warc.read_archives(spark, broken, whole=False).count() <= 4


def test_toxicity_query(spark):
    """Held-out rows are ranked well; every row has a score."""
    sf = "/root/testdata/sf0.01"
    got = queries.op10_toxicity(spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count() and got.where("score is null or score < 0 or score > 1 or predicted != cast(score >= 0.7 as int)").isEmpty()
    held = got.join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id").where("held_out").collect()
    bad, fine = ([g.score for g in held if g.toxic == t] for t in (1, 0))
    assert sum((b > f) + (b == f) / 2 for b in bad for f in fine) / (len(bad) * len(fine)) >= 0.85


def test_toxicity_on_odd_tables(spark):
    """An empty table, and columns with the names that the operator uses."""
    ddl = "doc_id long, text string, lang string, toxic int, _h long, _y int, _words string, words string, score double"
    rows = [(i, ("vile rotten " if i % 3 == 0 else "") + text(20, i), "en", int(i % 3 == 0), 1, 2, "w", "w", 0.0) for i in range(120)]
    rows += [(900, None, "en", 1, 1, 1, "", "", 0.0), (901, "", None, 0, 1, 1, "", "", 0.0), (902, "vile", "en", None, 1, 1, "", "", 0.0), (None, "x", "en", 0, 1, 1, "", "", 0.0), (903, "long " * 50_000, "en", 0, 1, 1, "", "", 0.0)]
    df = spark.createDataFrame(rows, ddl)
    model = toxicity.fit(df, "toxic")
    got = {g.doc_id: g for g in toxicity.score(df, model).collect()}
    assert len(got) == len(rows) and got[900].score == got[901].score and got[902].predicted == 1 and got[903].predicted == 0
    none = spark.createDataFrame([], ddl)
    assert toxicity.score(none, toxicity.fit(none, "toxic")).count() == 0


def test_pieces_by_plain_expectations():
    """One round of EM against sums over all segmentations."""
    v = langid.Vocabulary(queries.tokenizer_path(queries.PIECES))
    words, counts = [b"the", b"hunt", b"a"], np.array([3.0, 2.0, 1.0])
    number = lambda x: int(v.find(langid._substrings(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)])))[0])

    def cuts(w):
        if not w:
            yield []
        for n in range(1, len(w) + 1):
            if number(w[:n]) >= 0:
                yield from ([number(w[:n]), *rest] for rest in cuts(w[n:]))

    p = np.full(v.size, 1.0 / v.size)
    for _ in range(langid.ROUNDS):
        seen = np.zeros(v.size)
        for w, c in zip(words, counts):
            ways = list(cuts(w))
            weight = np.array([np.prod(p[x]) for x in ways])
            for x, share in zip(ways, c * weight / weight.sum()):
                np.add.at(seen, x, share)
        p = (seen + langid.FLOOR * seen.sum()) / (seen.sum() * (1 + langid.FLOOR * v.size))
    assert np.allclose(langid.fitted(words, counts, v), p, rtol=1e-6, atol=1e-12)

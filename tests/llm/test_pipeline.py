"""The pipeline's stages against plain versions, each on its own input."""

from __future__ import annotations

import corpus_pipeline
from filmstrip.llm.common import staged

from .test_llm import brute_cut, brute_near

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF))
        assert docs.columns == corpus_pipeline.COLUMNS
        held[name] = {r.doc_id: r.text for r in docs.collect()}
    language, near, repeats, clean = (held[n] for n, _ in corpus_pipeline.STAGES[:-1])
    assert len(language) >= 0.99 * spark.read.parquet(f"{SF}/documents.parquet").count()
    assert set(near) == {i for i, (_, c) in brute_near(list(language.items()), 5).items() if i == c}
    cut = {d: v[0] for d, v in brute_cut(list(near.items())).items()}
    assert repeats == {d: k.decode("utf-8", "ignore") for d, (k, n, gone, _) in cut.items() if gone < n or gone == 0}
    leaks = {d for d, t in repeats.items() if any(b in t for b in bench)}
    assert not leaks & set(clean) and len(set(repeats) - set(clean) - leaks) <= 0.02 * len(repeats)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(clean)


#: Columns of documents, and others whose names the operators use themselves.
WIDE = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, n long, node long, words string, item string, block long, kept string, rep long, _part string"


def wide(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "k", 2, 3, "w", "i", 4, "x", 5, "p") for i, t in rows], WIDE)


def test_stages_on_odd_rows(spark):
    """Null and repeated ids, null, empty and long texts, repeated rows, clashing names."""
    base = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars > 400").orderBy("doc_id").limit(12).collect()]
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    rows = [(None, base[0]), (None, base[0]), (None, None), (1, base[1]), (1, base[1]), (1, base[2]), (2, base[1] + " end"), (3, ""), (4, None), (5, base[3]), (5, base[4]), (6, base[5] + " " + leak), (None, base[6] + " " + leak), (7, " ".join(base) * 20), (8, "x" * 100_000)]
    docs = wide(spark, rows)
    texts = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    stages = dict(corpus_pipeline.STAGES)
    near = texts(stages["near_duplicates"](spark, docs, SF))
    gone = [(1, base[1]), (2, base[1] + " end")]  # one row of the group stays
    want = list(rows)
    for g in gone:
        want.remove(g)
    assert near == sorted(want, key=str)
    language = texts(stages["language"](spark, docs, SF))
    assert set(language) <= set(rows) and (3, "") not in language and (1, base[1]) in language and (None, base[0]) in language
    repeats = texts(stages["repeats"](spark, docs, SF))
    assert repeats.count((None, base[0])) == 2 and repeats.count((1, base[1])) == 2 and (4, "") in repeats
    clean = texts(stages["decontamination"](spark, docs, SF))
    assert clean == sorted((r for r in rows if leak not in (r[1] or "")), key=str)
    packed = stages["packing"](spark, docs, SF).where("piece = 0")
    assert sorted((r.doc_id for r in packed.collect()), key=str) == sorted((i for i, _ in rows), key=str)


def test_stages_on_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, wide(spark, []), SF).count() == 0

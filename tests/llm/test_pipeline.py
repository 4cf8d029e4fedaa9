"""The pipeline, stage by stage, against brute-force versions of its decisions."""

import re

import corpus_pipeline
import numpy as np
import pytest

from millrace.llm import pieces, quality

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    out = [spark.read.parquet(f"{DATA}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.write_table(stage(spark, out[-1], DATA), name))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "pieces"]
    for df in stages[1:5]:
        assert df.columns == stages[0].columns
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_keeps_clean(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    kept = ids(stages[1])
    good = [(i in kept) == bool(q) for i, q in labels.items() if i in ids(stages[0])]
    assert sum(good) >= 0.95 * len(good)
    model = quality.train(stages[0], spark.read.parquet(f"{DATA}/labels.parquet"))
    assert kept == {r.doc_id for r in quality.score(stages[0], model).collect() if r.score >= 0.5}


def test_near_duplicates(stages):
    def shingles(t):
        w = t.lower().split()
        return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())

    held = {r.doc_id: shingles(r.text) for r in stages[1].collect()}
    least = {i: i for i in held}
    order = sorted(held)
    for _ in range(3):
        for x, i in enumerate(order):
            for j in order[x + 1 :]:
                if held[i] and 100 * len(held[i] & held[j]) >= 80 * len(held[i] | held[j]):
                    least[i] = least[j] = min(least[i], least[j])
    assert ids(stages[2]) == {i for i, c in least.items() if i == c}


def test_decontamination(spark, stages):
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    passages = [plain(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in stages[2].collect() if any(p in plain(r.text) for p in passages)}
    assert bad and ids(stages[3]) == ids(stages[2]) - bad


def test_personal_data(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    rows = stages[4].collect()
    assert {r.doc_id for r in rows} == set(before)
    mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
    assert any(mail.search(t) for t in before.values())
    for r in rows:
        assert not mail.search(r.text) and r.n_chars == len(r.text)
        if not re.search(r"[0-9@]", before[r.doc_id]):
            assert r.text == before[r.doc_id]


def test_pieces(stages):
    model = pieces.PieceModel(pieces.model_bytes())
    got = {r.doc_id: r for r in stages[5].collect()}
    rows = stages[4].collect()
    flat, sizes = model.encode([r.text for r in rows])
    for r, end, n in zip(rows, np.cumsum(sizes), sizes, strict=True):
        assert got[r.doc_id].ids == flat[end - n : end].tolist() and got[r.doc_id].n_tokens == n


def test_odd_columns_and_rows(spark, stages):
    odd = spark.createDataFrame([(1, None, 1.0, 2, "c"), (None, "", 1.0, 2, "c"), (3, "words and more words", 1.0, 2, "c"), (3, "words and more words", 1.0, 2, "c")], "doc_id long, text string, score double, node long, base string")
    for df in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            df = corpus_pipeline.write_table(stage(spark, df, DATA), "odd")
            assert df.columns == odd.columns
        assert corpus_pipeline.STAGES[4][1](spark, df, DATA).columns[0] == "doc_id"

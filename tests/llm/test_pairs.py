"""Near-duplicates, components and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ann, neardup, shingles
from millrace.llm.graph import components


def sets(texts, k):
    out = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def groups(held, num, den):
    least = {i: i for i in held}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(held)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            common = len(held[i] & held[j])
            if held[i] and held[j] and den * common >= num * (len(held[i]) + len(held[j]) - common):
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return {i: find(i) for i in held}


@pytest.fixture(scope="module")
def family():
    """Chains of copies with growing changes, exact copies, a passage that many share, short and odd texts."""
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(4000)}"
    passage = [word() for _ in range(40)]
    texts, n = {}, 0
    for _ in range(6):
        base = [word() for _ in range(rnd.choice((12, 40, 120)))]
        for _ in range(12):
            texts[n], n = " ".join(base), n + 1
            base = list(base)
            for _ in range(rnd.randrange(1, 3)):
                base[rnd.randrange(len(base))] = word()
    for _ in range(25):
        texts[n], n = " ".join([*passage, *[word() for _ in range(rnd.randrange(3, 14))]]), n + 1
    for t in (None, "", " \n\t", "one", "one", "One two", "a b c d", "A  b c\nd", "word " * 2000, "x" * 9000, texts[0], texts[13].upper()):
        texts[n], n = t, n + 1
    return texts


SCHEMA = "doc_id long, text string, node long, n int, sig string, label int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "s", 3) for i, t in texts.items()], SCHEMA)


@pytest.mark.parametrize(("k", "num", "small"), [(3, 85, 48), (3, 85, 1), (5, 80, 1)])
def test_groups_equal_brute_force(spark, family, monkeypatch, k, num, small):
    monkeypatch.setattr(neardup, "SMALL", small)  # 1: every mixed bucket takes the way of the large ones
    monkeypatch.setattr(neardup, "UNIT", 512 if small > 1 else 3)
    got = {r.doc_id: r for r in neardup.grouped(frame(spark, family), k, num, 100).collect()}
    held = sets(family, k)
    assert {i: r.n for i, r in got.items()} == {i: len(s) for i, s in held.items()}
    assert {i: r.component_id for i, r in got.items()} == groups(held, num, 100)


def test_op7_columns_and_odd_rows(spark, family):
    texts = {i: t for i, t in family.items() if i < 14 or t is None or t == ""}
    df = frame(spark, texts).union(frame(spark, {0: texts[0], 1: "another text under the same id here"}))
    df = df.union(spark.createDataFrame([(None, texts[0], 1, 2, "s", 3)], SCHEMA))
    got = neardup.op7(df)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = got.collect()
    assert len(rows) == df.count() and all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert {r.component_id for r in rows if r.doc_id == 0} == {None}  # a null id is the least
    assert neardup.op7(df.limit(0)).count() == 0


def test_first_of_groups(spark, family):
    df = frame(spark, family)
    left = neardup.first_of_groups(df, 5, 80)
    assert left.columns == df.columns
    want = groups(sets(family, 5), 80, 100)
    assert sorted(r.doc_id for r in left.collect()) == sorted({i for i, c in want.items() if i == c})


def test_first_of_groups_with_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{j}" for j in range(60)) for x in "abc")
    near = b + " more"
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (5, b), (6, None), (6, None), (7, ""), (8, near), (8, near + " still"), (None, c)]
    df = spark.createDataFrame([(*r, 1, 2, "s", 3) for r in rows], SCHEMA)
    got = [(r.doc_id, r.text) for r in neardup.first_of_groups(df, 5, 80).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (None, c), (6, None), (7, "")], key=str)
    one = neardup.first_of_groups(df.where("doc_id = 8"), 5, 80)  # two near texts of one id
    assert one.count() == 1 and one.columns == df.columns


def test_units_lose_no_pair(spark):
    """A large bucket dealt to units: the same pairs as all against all, by the same rules."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 400, shingles.REGISTERS).astype(np.uint16)
    sigs = np.where(rng.random((60, shingles.REGISTERS)) < rng.choice([0.05, 0.2, 0.6], 60)[:, None], rng.integers(0, 400, (60, shingles.REGISTERS)), base).astype("<u2")
    n, place, label = rng.integers(80, 120, 60), rng.integers(0, 10, 60), rng.integers(0, 20, 60)
    classes = spark.createDataFrame([(i, sigs[i].tobytes()) for i in range(60)], "rep long, sig binary")
    large = spark.createDataFrame([(key, i, int(n[i]), int(place[i]), int(label[i]), 60) for key in (1, 2) for i in range(60)], "key long, rep long, n long, place int, label long, size long")
    want = set()
    for i in range(60):
        for j in range(i + 1, 60):
            room = min(n[i] - place[i], n[j] - place[j])
            fits = min(n[i], n[j]) * 100 >= max(n[i], n[j]) * 80 and room * 180 >= (n[i] + n[j]) * 80
            if label[i] != label[j] and fits and shingles.estimate(sigs[i : i + 1], sigs[j : j + 1])[0] >= 0.6:
                want.add((i, j))
    for unit in (512, 7, 1):
        neardup.UNIT, was = unit, neardup.UNIT
        try:
            got = [(r.a, r.b) for r in neardup._units(large, classes, 80, 100, 0.6).collect()]
        finally:
            neardup.UNIT = was
        assert want and sorted(got) == sorted(want)


def test_a_passage_that_very_many_share(spark):
    """Documents that share a passage and little else, some of them copied with a change: only those meet."""
    rnd = random.Random(2)
    passage = " ".join(f"p{k}" for k in range(70))
    texts = [f"{passage} {' '.join(f'w{rnd.randrange(10**6)}' for _ in range(40))}" for _ in range(3000)]
    texts += [t + " end" for t in texts[:50]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.op7(df).collect()}
    assert got == {i: i if i < 3000 else i - 3000 for i in range(3050)}


def test_registers_and_bands():
    rng = np.random.default_rng(0)
    for n in (7, 30, 300):
        es, hits = [], 0
        for _ in range(150):
            u = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
            cut = max(1, round(n * 0.075))
            a, b = (u[:-cut], u[cut:]) if n > 20 else (u[:-1], u)
            sig = shingles.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
            es.append(shingles.estimate(sig[:1], sig[1:])[0])
            keys = shingles.band_keys(sig)
            hits += bool((keys[0] == keys[1]).any())
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(np.mean(es) - true) < 0.01 and hits == 150
    far = shingles.signatures(np.sort(rng.integers(0, 2**63, 2000, dtype=np.uint64)), np.array([1000, 1000]))
    assert shingles.estimate(far[:1], far[1:])[0] < 0.05


def test_bands_by_threshold(spark):
    assert neardup.bands(85, 100) == 32 and neardup.bands(80, 100) == 48
    for num in (50, 80, 85, 95):
        b = neardup.bands(num, 100)
        assert shingles.REGISTERS % b == 0 and (1 - (num / 100) ** (shingles.REGISTERS // b)) ** b <= neardup.MISSED
    rows = spark.createDataFrame([(1, 9, bytes(2 * shingles.REGISTERS))], "rep long, n long, sig binary")
    assert neardup._banded(rows, neardup.bands(80, 100)).count() == 48


def test_components(spark):
    rnd = random.Random(1)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 480)] + [(900, k) for k in range(500, 560)] + [(7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    least = {x: x for e in links for x in e}
    for _ in range(500):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    assert got == {n: m for n, m in least.items() if n in got} and set(least) - set(got) <= {7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# nearest neighbours


def nearest(vectors, queries, top=5):
    out = {}
    for q in queries:
        scores = [(-float(np.dot(v, vectors[q][1]) / np.linalg.norm(v) / np.linalg.norm(vectors[q][1])), i) for i, v in vectors if i != vectors[q][0]]
        out[vectors[q][0]] = sorted(scores)[:top]
    return out


SHAPE = "vec_id long, embedding array<float>, label int, rank int, score double"


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_BYTES", 5 * 8 * 70)  # several blocks
    monkeypatch.setattr(ann, "TILE", 3)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 70))
    x = (centres[rng.integers(0, 6, 600)] + 0.5 * rng.normal(size=(600, 70))).astype(np.float32)
    x[100:160] = x[50]  # one very common vector
    rows = [(i, v.tolist(), 0, 0, 0.0) for i, v in enumerate(x)]
    odd = [None, [], [0.0] * 70, [float("nan")] * 70, [float("inf")] + [1.0] * 69, [None] + [1.0] * 69]
    rows += [(1000 + 50 * i, v, 0, 0, 0.0) for i, v in enumerate(odd)] + [(None, x[0].tolist(), 0, 0, 0.0)]
    got = {}
    for r in ann.op3(spark.createDataFrame(rows, SHAPE)).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    vectors = [(i, v.astype(float)) for i, v in enumerate(x)]
    want = nearest(vectors, range(0, 600, 50))
    assert set(got) == set(want)
    hits = 0
    for q, rows in want.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        for k, (s, _) in enumerate(rows):
            assert abs(got[q][k + 1][1] + s) < 1e-9 or got[q][k + 1][1] < -s
        hits += len({i for i, _ in got[q].values()} & {i for _, i in rows})
    assert hits >= 0.9 * 5 * len(want)
    assert [got[50][k][0] for k in range(1, 6)] == [100, 101, 102, 103, 104]  # ties go to smaller ids


def test_few_or_no_candidates(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0], 0, 0, 0.0), (7, [2.0], 0, 0, 0.0)], SHAPE)
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.op3(two).collect()] == [(0, 1, 7)]
    assert ann.op3(two.limit(0)).count() == 0 and ann.op3(two.where("vec_id = 7")).count() == 0


def test_any_doubles_and_repeated_ids(spark):
    """Components from 1e-170 to 1e200, subnormal ones, and rows that share a vec_id: equal to exact cosines."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    rnd = random.Random(3)
    rows = [(50 * k, [rnd.choice((-1, 1)) * rnd.random() * 10.0 ** rnd.choice(e) for _ in range(4)]) for k, e in enumerate([(-170, -169), (200, 199), (0, 1), (-170, 200), (-310, -309), (307,)])]
    rows += [(0, [1e-170, 2e-170, 0.0, 0.0]), (0, [1e-170, 2e-170, 0.0, 0.0]), (7, [5e-324, 0.0, 0.0, 0.0]), (9, [1e200, 1e200]), (9, [-1e200, 1e-200])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, row int")

    def cosine(a, b):
        a, b = ([*map(Decimal, x), *[Decimal(0)] * (4 - len(x))] for x in (a, b))
        length = lambda x: sum(c * c for c in x).sqrt()
        return float(sum(c * d for c, d in zip(a, b, strict=True)) / (length(a) * length(b)))

    want = []
    for k, (q, a) in enumerate(rows):
        if q % 50 == 0:
            want.append((q, [(round(s, 9), i) for s, i in sorted(((cosine(a, b), i) for j, (i, b) in enumerate(rows) if j != k), key=lambda x: (-round(x[0], 9), x[1]))[:5]]))
    for exact in (False, True):
        got = {}
        for r in ann.search(df, F.col("vec_id") % 50 == 0, exact=exact).collect():
            got.setdefault((r.query_id, r["rank"]), []).append((round(r.score, 9), r.vec_id))
        for rank in range(1, 6):
            for q in {q for q, _ in want}:
                assert sorted(got[q, rank]) == sorted(best[rank - 1] for i, best in want if i == q), (q, rank, exact)
    other = spark.createDataFrame([(3, [2e-170, 4e-170], 0)], "vec_id long, embedding array<double>, row int")
    assert [(r.query_id, r.vec_id, round(r.score, 9)) for r in ann.search(df, other, 2).collect()] == [(3, 0, 1.0), (3, 0, 1.0)]


def test_recall_on_a_whole_table(spark):
    """Against all pairs on sf0.1's vectors: at least 0.9 of the five nearest by codes, all of them in the exact mode."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in df.collect()]
    ids, x = np.array([i for i, _ in rows]), ann.unit(np.stack([v for _, v in rows]))
    q = np.flatnonzero(ids % 50 == 0)
    scores = x[q] @ x.T
    scores[np.arange(len(q)), q] = -2
    fifth = np.sort(scores, axis=1)[:, -5]
    for exact, least in ((False, 0.99), (True, 1.0)):
        got = ann.search(df, F.col("vec_id") % 50 == 0, exact=exact).collect()
        floor = dict(zip(ids[q].tolist(), fifth.tolist(), strict=True))
        hits = sum(r.score >= floor[r.query_id] - 1e-9 for r in got)
        print("recall", exact, hits / (5 * len(q)))
        assert len(got) == 5 * len(q) and hits >= least * len(got)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2000, 64))
    codec = ann.Codec(x[:500], 64)
    codes, near, *scalars = codec.encode(x)
    block, over, n = ann.Block(codec, np.arange(20), np.arange(20), x[:20]), 0, 0
    u = ann.unit(x)
    for c in np.unique(near):
        rows = near == c
        upper = block.bounds(np.arange(20), int(c), codes[rows].view("<u8"), *(s[rows] for s in scalars))
        true = u[:20] @ u[rows].T
        over, n = over + (true > upper).sum(), n + true.size
    assert over < 0.01 * n



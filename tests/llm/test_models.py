"""The operators that learn: quality, language, language model."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, lm, quality


@pytest.fixture(scope="module")
def labels(spark, corpus):
    rows = [(i, int("$$$" not in t), 0) for i, t, *_ in corpus if i is not None and i < 100 and t] + [(7, None, None), (None, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def held(i, n, r):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n == r


def test_quality(docs, labels, corpus):
    got = quality.op9(docs, labels).collect()
    assert len(got) == len(corpus)
    truth = {i: "$$$" not in t for i, t, *_ in corpus if i is not None and i < 100}
    tested = [r for r in got if r.held_out and r.doc_id in truth]
    assert tested and sum(r.predicted == truth[r.doc_id] for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == held(r.doc_id, 3, 1) for r in got)


def test_quality_without_labels(docs, labels, none):
    assert {r.score for r in quality.op9(docs, labels.limit(0)).collect()} == {0.5}
    one = labels.where("quality = 1")
    assert all(r.score > 0.99 for r in quality.op9(docs, one).collect())
    assert quality.op9(none, labels).count() == 0


def test_quality_features_are_those_of_each_text():
    made = quality.Features()
    texts = ["a b a", None, "", "c"]
    feats, owner, counts = made.batch(texts)
    assert counts.tolist() == [3, 0, 0, 1] and Counter(owner.tolist()) == {0: 3 + 3 + 2 + 2 + 1, 3: 2}
    alone = made.batch(["c"])[0]
    assert sorted(feats[owner == 3].tolist()) == sorted(alone.tolist())


def plain_features(text, bits):
    """The features by definition, word by word, in unbounded integers cut to 64 bits."""
    cut, odd = (1 << 64) - 1, 0xD6E8FEB86659FD93

    def hashed(x, family):
        x = (x + family) * odd & cut
        x = (x ^ (x >> 32)) * odd & cut
        return (x ^ (x >> 32)) & ((1 << bits) - 1)

    def join(a, b):
        return (a * 0x9E3779B97F4A7C15 & cut) ^ ((b + 0x632BE59BD9B4E019) & cut)

    def outline(w):
        signs = ["9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in w]
        out = [c for k, c in enumerate(signs) if not k or c != signs[k - 1] or c not in "Aa9"]
        return "".join(c for k, c in enumerate(out) if k < 3 or not (c == out[k - 1] == out[k - 2] == out[k - 3]))

    w = (text or "").split()
    core = [zlib.crc32(x.lower().strip(".,;:!?#$%&*|()[]{}\"'<>/\\-_=+~^").encode()) for x in w]
    line = [61 if k and w[k - 1] == x else zlib.crc32(outline(x).encode()) for k, x in enumerate(w)]
    out = Counter([hashed(c, 1) for c in core] + [hashed(o, 2) for o in line])
    out.update(hashed(join(a, b), 3) for a, b in zip(core, core[1:], strict=False))
    out.update(hashed(join(a, b), 4) for a, b in zip(line, line[1:], strict=False))
    out.update(hashed(join(join(a, b), c), 5) for a, b, c in zip(line, line[1:], line[2:], strict=False))
    return {k: quality.SCALE * n / len(w) for k, n in out.items()}


def test_quality_scores_equal_plain_ftrl(spark):
    """Weights and scores against updates made one coordinate at a time, with averaged labels, ties and words that differ late."""
    bits, long = 10, "x" * 70
    texts = {1: "Good words, and more words.", 2: "$$$ buy 99 99 !!! $$$$$$", 3: f"{long}! {long}A", 4: None, 5: "", 6: "ok ok ok fine", 7: f"{long}1 {long}B", 8: "Words and words", 9: "!!! $$$ 1", 10: "good good"}
    docs = spark.createDataFrame([(i, t, 0.5, 3) for i, t in texts.items()], "doc_id long, text string, score double, place int")
    marks = [(1, 1), (2, 0), (3, 1), (3, 0), (6, 1), (6, 0), (6, 0), (8, 1), (9, 0), (9, None), (4, 1), (None, 1), (10, 1)]
    labels = spark.createDataFrame([(i, q, 0) for i, q in marks], "doc_id long, quality int, label int")
    w, bias = quality.train(docs, labels, bits=bits)
    mean = {i: sum(q for j, q in marks if j == i and q is not None) / sum(j == i and q is not None for j, q in marks) for i, _ in marks if i is not None}
    ids = [i for i in mean if not held(i, 3, 1)]
    hashes = {r.doc_id: r.h for r in docs.selectExpr("doc_id", "xxhash64(doc_id) as h").collect()}
    rows = [(plain_features(texts[i], bits) | {1 << bits: 1.0}, float(mean[i] >= 0.5)) for i in sorted(ids, key=lambda i: hashes[i])]
    assert {y for _, y in rows} == {0.0, 1.0}
    z, n, alpha, beta, l1, l2 = Counter(), Counter(), 0.3, 1.0, 0.002, 0.02
    weight = lambda k: 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)
    order = np.random.default_rng(7)
    for _ in range(3):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            now = {j: weight(j) for j in x}
            p = 1 / (1 + math.exp(-sum(now[j] * v for j, v in x.items())))
            for j, v in x.items():
                g = (p - y) * v
                z[j] += g - (math.sqrt(n[j] + g * g) - math.sqrt(n[j])) / alpha * now[j]
                n[j] += g * g
    assert np.allclose(w, [weight(j) for j in range(1 << bits)], atol=1e-5) and math.isclose(bias, weight(1 << bits), abs_tol=1e-9)
    for r in quality.score(docs.drop("score"), (w, bias), bits).collect():
        want = bias + sum(v * w[j] for j, v in plain_features(texts[r.doc_id], bits).items())
        assert math.isclose(r.score, 1 / (1 + math.exp(-want)), abs_tol=1e-6)
    assert quality.Features(bits).batch([texts[3]])[0].tolist() != quality.Features(bits).batch([texts[7]])[0].tolist()


def test_language(docs, corpus):
    got = langid.op8(docs).collect()
    want = {i: (lang, t) for i, t, lang, _ in corpus}
    assert len(got) == len(corpus)
    good = [r.lang_pred == want[r.doc_id][0] for r in got if want[r.doc_id][0] and r.doc_id is not None and r.held_out]
    assert good and sum(good) >= 0.9 * len(good)
    for r in got:
        if not any(c.isalpha() for c in want[r.doc_id][1] or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        assert 0 <= r.score <= 1 and r.held_out == held(r.doc_id, 5, 0)


def test_language_empty(none):
    assert langid.op8(none).count() == 0


def phrases(text, source):
    """Greedy longest matches over the whole text."""
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in source:
            k += 1
        n, at = n + 1, at + k
    return n


@pytest.mark.parametrize("block", [1, 2, 7, 1024])
def test_parse_equals_longest_matches(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block)
    rnd = np.random.default_rng(0)
    train = {"x": ["abcabcabd banana", "aaaaaaaaaaaa"], "y": ["the cat sat on the mat"]}
    p = langid.Parser(train)
    p.open()
    texts = ["abcabd banab the cat q mat", "zzz", "a" * 3000, "abc" * 700 + "the cat sat on the mat" * 30]
    texts += ["".join(rnd.choice(list("abcdhet \u4e00"), rnd.integers(1, 400))) for _ in range(40)]
    bits, letters = p.entropies(texts)
    assert letters[:4].all()
    for lang, held_texts in train.items():
        source = "".join(chr(c) if c else " " for t in held_texts for c in [*langid.plain(t), 0])
        for i, t in enumerate(texts):
            plain = "".join(chr(c) if c else " " for c in langid.plain(t))
            x = p.langs.index(lang)
            assert math.isclose(bits[i, x], phrases(plain, source) * p.weight[x] / len(plain)), (lang, t)


def test_language_of_one_ties_and_long_training_texts(spark):
    schema = "doc_id long, text string, lang string, odd int"
    rows = [(i, "only one language here", "en", 0) for i in range(1, 9)]
    one = langid.op8(spark.createDataFrame([*rows, (99, "日本", None, 0), (100, "12", None, 0)], schema)).collect()
    assert {(r.lang_pred, r.score) for r in one if r.doc_id < 100} == {("en", 1.0)} and [(r.lang_pred, r.score) for r in one if r.doc_id == 100] == [("und", 0.0)]
    two = [(i, "the same words for both", lang, 0) for i in range(1, 30) for lang in ("b", "a")]
    assert {(r.lang_pred, r.score) for r in langid.op8(spark.createDataFrame(two, schema)).collect()} == {("a", 0.5)}
    long = [(1, "lorem ipsum dolor " * 5000 + "zyx", "la", 0), (2, "lorem ipsum dolor " * 4000 + "unde omnis", "la", 0), (3, "wer weiss das schon", "de", 0)]
    df = spark.createDataFrame(long, schema)
    texts = langid.train(df)
    assert texts.langs == ["de", "la"] and texts.weight[1] == math.log2(len(langid.plain(long[1][1])) + 2)  # the shortest, whole
    assert langid.train(df, max_chars=80_000).weight[1] == texts.weight[1]


def test_a_large_script():
    """Two made-up languages over one script of thousands of letters, beside a Latin one."""
    rnd = np.random.default_rng(5)
    made = {}
    for lang in ("p", "q"):
        made[lang] = ["".join(chr(0x4E00 + k) for k in rnd.integers(0, 3000, 2)) for _ in range(600)]
    made["en"] = "the of and to in is it that was for on with as his they be at one have this".split()
    text = lambda lang: " ".join(rnd.choice(made[lang], 12))
    p = langid.Parser({lang: [text(lang) for _ in range(400)] for lang in made})
    p.open()
    truth = [lang for lang in made for _ in range(60)]
    bits, _ = p.entropies([text(lang) for lang in truth])
    assert sum(p.langs[k] == lang for k, lang in zip(bits.argmin(1), truth, strict=True)) >= 0.97 * len(truth)


def test_every_trained_letter_is_evidence():
    """Letters past the LETTERS most frequent: texts of them alone go to their language, phrases are the longest matches."""
    often = [chr(0x4E00 + i) for i in range(langid.LETTERS)]
    rare = {x: [chr(at + i) for i in range(300)] for x, at in (("x", 0x5000), ("y", 0x6000))}
    train = {x: ["".join(often) * 20 + "".join(r) * (2 if x == "x" else 1)] for x, r in rare.items()}
    p = langid.Parser(train)
    p.open()
    texts = ["".join(r[40:90]) for r in rare.values()] + [often[3] + rare["x"][7] + "\u7fff" + rare["y"][8]]
    bits, letters = p.entropies(texts)
    assert letters.all() and [p.langs[k] for k in bits[:2].argmin(1)] == ["x", "y"]
    for x, (source,) in train.items():
        for i, t in enumerate(texts):
            n, left = 0, t
            while left:
                k = max((k for k in range(1, len(left) + 1) if left[:k] in source), default=1)
                n, left = n + 1, left[k:]
            assert math.isclose(bits[i, p.langs.index(x)], n * p.weight[p.langs.index(x)] / len(t)), (x, t)


def test_language_model(docs, corpus):
    got = lm.op1(docs).collect()
    assert len(got) == len(corpus)
    count = Counter()
    for i, t, *_ in corpus:
        if not held(i, 7, 2):
            count.update([*(t or "").encode().lower().split(), lm.END])
    total, distinct = sum(count.values()), len(count)
    texts = {i: t for i, t, *_ in corpus}
    for r in got:
        w = [*(texts[r.doc_id] or "").encode().lower().split(), lm.END]
        base = sum(math.log10((count[x] + 1) / (total + distinct + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(x in count for x in w), total, held(r.doc_id, 7, 2))
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and r.score < 0


def test_scores_equal_plain_forward(spark):
    """The final score token by token: emission classes, the scaled forward sum and a rare word's share; very long texts and words, ties, odd columns."""
    rnd = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(60)] + ["Tie", "tie", "x" * 64, "x" * 65, "y" * 5000, "z" * 5000]
    texts = [" ".join(rnd.choice(vocabulary, rnd.integers(0, 40))) for _ in range(60)] + [" ".join(rnd.choice(vocabulary, 3000)), None, "", "never seen words"]
    df = spark.createDataFrame([(i, t, 1, 2, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, row int, c int, score double")
    learned = [i for i in range(len(texts)) if not held(i, 7, 2)]
    plain = df.select("doc_id", "text").where(F.col("doc_id").isin(learned))
    trained = lm.train(plain, sample_chars=100_000)
    assert lm.train(plain, sample_chars=0, rounds=1).total == trained.total  # without a text short enough the shortest starts
    count = Counter()
    for i in learned:
        count.update(lm.words(texts[i]))
    assert set(trained.hot) == {w for w in count if len(w) <= 64} and (b"x" * 64) in trained.hot
    rare = Counter()
    for w, c in count.items():
        if w not in trained.hot:
            rare[zlib.crc32(w[-3:]) % lm.CLASSES] += c + 1
    assert rare[zlib.crc32(b"yyy") % lm.CLASSES] == count[b"y" * 5000] + 1
    model = trained.model
    for r in lm.op1(df).collect():
        w = lm.words(texts[r.doc_id])
        total, alpha = 0.0, None
        for x in w:
            k = trained.hot.get(x, lm.HOT + zlib.crc32(x[-3:]) % lm.CLASSES)
            moved = model.start if alpha is None else [sum(alpha[a] * model.move[a, b] for a in range(lm.STATES)) for b in range(lm.STATES)]
            alpha = [moved[b] * model.emit[k, b] for b in range(lm.STATES)]
            scale = sum(alpha)
            alpha, total = [v / scale for v in alpha], total + math.log10(scale)
            if x not in trained.hot:
                total += math.log10((count[x] + 1) / (rare[k - lm.HOT] + 1))
        assert math.isclose(r.score, total, rel_tol=1e-7, abs_tol=1e-7), texts[r.doc_id]


def test_language_model_empty(none, docs):
    assert lm.op1(none).count() == 0
    few = docs.where("doc_id is not null").limit(1)
    assert all(math.isfinite(r.score) for r in lm.op1(few).collect())


def tiny(n=3, m=5, seed=0):
    rng = np.random.default_rng(seed)
    return lm.Model(rng.dirichlet(np.ones(n)), rng.dirichlet(np.ones(n), n), rng.dirichlet(np.ones(m), n).T)


def test_forward_is_exact():
    """Against the sum over all state paths, and a distribution over texts that sums to one."""
    from itertools import product

    model = tiny()
    for seq in ([0], [1, 2], [4, 0, 3, 3]):
        want = 0.0
        for path in product(range(3), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, w in zip(path, path[1:], seq[1:], strict=False):
                p *= model.move[a, b] * model.emit[w, b]
            want += p
        got = lm.forward(model, np.array([2, *seq, 1]), np.array([1, len(seq), 1]))
        assert math.isclose(10 ** got[1], want, rel_tol=1e-12)
    every = [list(s) for s in product(range(5), repeat=3)]
    assert math.isclose(sum(10 ** lm.forward(model, np.array(sum(every, [])), np.full(125, 3))), 1.0)


def test_stretches_count_as_whole_texts(monkeypatch):
    """Expected counts against the sum over all state paths, and a model learned in stretches equal to one without."""
    from itertools import product

    model, seqs = tiny(), [[1], [4, 0, 3, 3, 2, 1, 0], [2, 2, 4, 1]]
    want = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for seq in seqs:
        ps = {}
        for path in product(range(3), repeat=len(seq)):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, w in zip(path, path[1:], seq[1:], strict=False):
                p *= model.move[a, b] * model.emit[w, b]
            ps[path] = p
        total = sum(ps.values())
        for path, p in ps.items():
            want[0][path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                want[1][a, b] += p / total
            for w, a in zip(seq, path, strict=True):
                want[2][w, a] += p / total
    rnd = np.random.default_rng(2)
    texts = [" ".join(f"w{k}" for k in rnd.integers(0, 9, n)) for n in (1, 5, 40, 41, 90)]
    share, learned = np.full(lm.HOT + lm.CLASSES, 1 / (lm.HOT + lm.CLASSES)), []
    for segment in (2, 3, 10**6):
        monkeypatch.setattr(lm, "SEGMENT", segment)
        got = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
        lm.expected(model, np.array(sum(seqs, [])), np.array(list(map(len, seqs))), got)
        assert all(np.allclose(x, y, rtol=1e-10) for x, y in zip(got, want, strict=True))
        learned.append(lm.first_model(texts, {f"w{k}".encode(): k for k in range(9)}, share, 3))
    for m in learned[:2]:
        assert np.allclose(m.start, learned[2].start) and np.allclose(m.move, learned[2].move) and np.allclose(m.emit, learned[2].emit)


def test_baum_welch_raises_likelihood():
    rng = np.random.default_rng(1)
    flat, sizes = rng.integers(0, 5, 400), np.full(20, 20)
    model, last = tiny(seed=4), -np.inf
    for _ in range(6):
        now = lm.forward(model, flat, sizes).sum()
        assert now >= last - 1e-9
        last = now
        into = (np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)))
        lm.expected(model, flat, sizes, into)
        assert math.isclose(into[2].sum(), 400) and math.isclose(into[1].sum(), 380) and math.isclose(into[0].sum(), 20)
        model = lm.Model(into[0] / 20, into[1] / into[1].sum(1, keepdims=True), into[2] / into[2].sum(0))

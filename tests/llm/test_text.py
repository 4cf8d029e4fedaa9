"""The SQL-function operators: licences, personal data, decontamination."""

import hashlib
import itertools
import math
import os
import random
import re
from collections import Counter

import duckdb
import pytest
import regex

from millrace.llm import decontam, licenses, pii

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, words string, base string, r string, start int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "w", "b", "r", 0) for i, t in enumerate(texts)], SCHEMA)


# licences

MIT = "\n".join(licenses.SENTENCES[k].capitalize() + "." for k in ("mit-grant", "mit-notice", "as-is-short", "mit-liability"))


def test_license_rules(spark):
    wrapped = re.sub(r"((?:\S+ ){7}\S+) ", r"\1\n", MIT.replace("\n", " "))
    texts = ["Prose.\nReleased under the MIT License.", "x. Licensed under the Apache License, Version 2.0. More", MIT, wrapped, None, "", "all rights\nreserved",
             "Licensed under CC BY-NC 4.0.\nfoo\nLicensed under CC BY-NC 4.0.", "no licence at all, only permission", licenses.SENTENCES["mit-liability"] + ".\n" + licenses.SENTENCES["mit-grant"]]
    got = {(r.doc_id, r.license, r.rule): r.found for r in licenses.scan(frame(spark, texts)).collect()}
    assert got == {
        (0, "MIT", "notice"): 1, (1, "Apache-2.0", "notice"): 1, (2, "MIT", "text"): 1, (3, "MIT", "text"): 1,
        (6, "all-rights-reserved", "notice"): 1, (7, "CC-BY-NC-4.0", "notice"): 2, (9, "MIT", "grant"): 1,
    }
    assert licenses.scan(frame(spark, texts).limit(0)).count() == 0


def test_license_sql(spark):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = licenses.scan(spark.read.parquet(f"{DATA}/documents.parquet"))
    want = db.sql(licenses.op5_sql())
    assert df.columns == want.columns and sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_every_wording_has_a_trigger():
    """A text that a rule is found in has one of the trigger's words: of the rule's sentences, one has them in all wordings."""
    book = licenses.BOOK
    lead = {s: "available " + s if s.startswith("under ") else s for s in book.sentences}
    sure = {k for k in book.sentences.values() if all(re.search(licenses.TRIGGER, lead[s]) for s, x in book.sentences.items() if x == k)}
    assert [r for r in book.rules if not sure & {*r[2]}] == []


NOTICED = {
    "// SPDX-License-Identifier: Apache-2.0\nint x;": ("Apache-2.0", "spdx"), "# SPDX-License-Identifier:GPL-2.0-or-later": ("GPL-2.0-or-later", "spdx"), "/* SPDX-License-Identifier: BSD-3-Clause */": ("BSD-3-Clause", "spdx"),
    "Read on. This project is licensed under the terms of the MIT licence. Enjoy.": ("MIT", "notice"), "Dieses Projekt steht unter der Apache License 2.0.": ("Apache-2.0", "notice"), "Ce projet est sous licence GPLv3.": ("GPL-3.0", "notice"),
    "Este proyecto está bajo la CC BY-SA 4.0.": ("CC-BY-SA-4.0", "notice"), "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": ("CC-BY-NC-4.0", "notice"), "Available under Apache 2.0.": ("Apache-2.0", "notice"), "Dieses Projekt steht unter der GPLv3.": ("GPL-3.0", "notice"), "Available under the GNU AGPL v3.": ("AGPL-3.0", "notice"),
    "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.": ("GPL-2.0-or-later", "grant"),
    "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": ("LGPL-3.0-or-later", "grant"),
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": ("Zlib", "text"),
}


def test_wordings_written_apart_from_the_book(spark):
    held = [*NOTICED, "MIT", "a mit", "no license here, only permission", "x " * 100_000 + "\nReleased under the MIT License.\n" + "y. " * 50_000]
    got = {}
    for r in licenses.scan(frame(spark, held + [held[0]])).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.rule))
    want = {i: [x] for i, x in enumerate(NOTICED.values())} | {len(held) - 1: [("MIT", "notice")], len(held): [("Apache-2.0", "spdx")]}
    assert got == want


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.exists(f"{COMMON}/GPL-3"), reason="no licence texts on this machine")
def test_full_texts(spark):
    """Real licence texts: those the book knows, and those it learns by `with_text`, wrapped otherwise and with a sentence changed."""
    text = {n: open(f"{COMMON}/{n}").read() for n in ("BSD", "Apache-2.0", "MPL-2.0", "GPL-3")}  # noqa: SIM115
    assert [(r.license, r.rule) for r in licenses.scan(frame(spark, [text["BSD"]])).collect() if r.rule == "text"] == [("BSD-3-Clause", "text")]
    book = licenses.BOOK
    for n in ("Apache-2.0", "MPL-2.0", "GPL-3"):
        book = book.with_text(n, text[n])
    assert all(len(ids) > 30 for name, rule, ids in book.rules[-3:])
    wrapped = {n: " ".join(t.split()) for n, t in text.items()}
    changed = wrapped["MPL-2.0"].replace("Contributor", "Giver", 1)
    held = ["prose before. " + wrapped["Apache-2.0"] + " prose after", text["MPL-2.0"], text["GPL-3"], changed, wrapped["Apache-2.0"][:5000]]
    got = {(r.doc_id, r.license) for r in licenses.scan(frame(spark, held), book).collect() if r.rule == "text" and r.sentences > 30}
    assert got == {(0, "Apache-2.0"), (1, "MPL-2.0"), (2, "GPL-3")}


# personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(reversed(digits))) % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS.values()) for m in re.finditer(p, text or "") if passes(list(PATTERNS)[k], m[0]))


def named(spans):
    return [f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in spans]


def texts():
    rnd = random.Random(2)
    fixed = [None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 999.1.1.1 0001.002.3.4", "ñé😀 4918187128635271 ñ 10.0.0.1", "+1 (578) 555-6437 4918187128635271 ered", "4111 1111 1111 1111 and 4111-1111-1111-1112",
             "a" * 60_000 + "@", "a@" + "b." * 30_000, "1 " * 30_000, "1.1." * 15_000, "+" * 1000, " ".join(f"a{i}@b.co" for i in range(1500)), "12-34", 'token = "18945874088f67dc02ebee7da32856e8cab6c30f" end']
    return fixed + ["".join(rnd.choice("ab1234567890. -+@()é") for _ in range(rnd.randrange(120))) for _ in range(400)]


def test_base_spans_equal_the_patterns(spark):
    held = texts()
    got = {r.doc_id: r for r in pii.op4(frame(spark, held)).collect()}
    assert len(got) == len(held)
    for i, t in enumerate(held):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(named(want)).encode()).hexdigest(), t
        n = Counter(k for _, k, _ in want)
        assert (got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) == tuple(n[k] for k in range(4))
        spans = got[i].spans.split(",") if got[i].spans else []
        assert set(named(want)) <= set(spans)
        assert spans == sorted(spans, key=lambda s: (int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])))


def test_added_spans(spark):
    held = ["+1 (578) 555-6437 4918187128635271 ered"] + ['a token = "%040x" here' % (7**40 + i) for i in range(20)] + ["clean prose with 12 numbers, 3.14 and 1999-2004"] * 5
    got = {r.doc_id: r.spans for r in pii.op4(frame(spark, held)).collect()}
    assert got[0] == "phone:0:17,card:18:34" and got[3].startswith("secret:11:") and got[25] == ""


def test_candidates_need_no_sign_of_the_base_pattern(spark):
    """A mail without @ and a phone without + are tried and found whatever else the text holds."""
    one = [f"call (555) 123-{i:04d} today" for i in range(20)] + [f"write to joe{i}[at]host[dot]org now" for i in range(20)]
    kinds = lambda t: {(pii.KINDS.index("phone"), 5, 19)} if "call" in t else {(pii.KINDS.index("email"), 9, t.index(" now"))}
    for held in (one, [t + " @ +" for t in one]):
        tried = pii.scanned(frame(spark, held)).collect()
        assert all({(c.kind, c.start, c.end) for c in r.tried} == kinds(held[r.doc_id]) for r in tried)
    rows = [f"phone: +1-555-123-{i:04d}" for i in range(40)] + [f"phone: (555) 123-{i:04d}" for i in range(40)]
    want, _ = plain_spans(rows)
    got = {r.doc_id: r.spans for r in pii.op4(frame(spark, rows)).collect()}
    assert all(got[i] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans) for i, spans in enumerate(want))


def test_words_before_a_span_at_any_distance(spark):
    """The whole gap since the last match counts, in linear time; decisions of the pipeline's stage follow."""
    import time

    import corpus_pipeline

    key, far = "18945874088f67dc02ebee7da32856e8cab6c30f", "x.y:" * 20
    held = [f"token {'.' * 60} {key}", f"see https://{far}{key}", f"see {far}{key}", f"Sozialversicherungsnummer{'vergabestelle' * 4}: 123-45-6789"]
    tried = {r.doc_id: [(c.kind, *c.votes[3:]) for c in r.tried] for r in pii.scanned(frame(spark, held)).collect()}
    secret, ssn = pii.KINDS.index("secret"), pii.KINDS.index("ssn")
    assert tried == {0: [(secret, 1, -1)], 1: [(secret, -1, 0)], 2: [(secret, -1, -1)], 3: [(ssn, 1, -1)]}
    rows = [f"ssn {'.' * 60} 812-45-67{i}" for i in range(10, 40)] + [f"part 912-45-67{i}" for i in range(10, 40)]
    got = {r.doc_id: r.text for r in corpus_pipeline.personal_data_stage(spark, frame(spark, rows), "").select("doc_id", "text").collect()}
    assert got == {i: f"ssn {'.' * 60} <SSN>" if i < 30 else t for i, t in enumerate(rows)}
    began = time.monotonic()
    long = ["http://" * 60_000 + " " + key, "escrib" * 60_000 + "! a[at]b.org", "llam" * 90_000 + " é (555) 123-4567", "steuer" * 60_000 + "é x 123-45-6789", "no " * 100_000 + "." * 300_000 + "x 123-45-6789"]
    assert len(pii.scanned(frame(spark, long)).select("doc_id", "tried").collect()) == len(long)
    assert time.monotonic() - began < 60


def test_reliabilities():
    counts = [(0, (1, 1, 1, -1, -1), 80), (0, (0, 0, 0, -1, 0), 90), (0, (1, 1, 0, -1, -1), 10), (0, (0, 1, 0, -1, -1), 10)]
    post = pii.reliabilities(counts)
    assert post[0, (1, 1, 1, -1, -1)] > 0.9 > 0.1 > post[0, (0, 0, 0, -1, 0)]


def test_redaction(spark):
    held = ["mail a.b@c.de now", None, "no data", "1.2.3.4 and 5.6.7.8", "ñ 4918187128635271", "+1 (578) 555-6437 4918187128635271"]
    df = frame(spark, held)
    got = pii.redact(df)
    assert got.columns == df.columns
    assert [r.text for r in got.orderBy("doc_id").collect()] == ["mail <EMAIL> now", None, "no data", "<IP> and <IP>", "ñ <CARD>", "<PHONE> <CARD>"]
    assert pii.redact(df.limit(0)).count() == 0 and pii.op4(df.limit(0)).count() == 0


def plain_votes(kind, value, before):
    """The five labelers, by definition."""
    has = lambda p, t: bool(regex.search(p, t, flags=regex.ASCII))
    digits = re.sub("[^0-9]", "", value)
    if kind in PATTERNS and kind != "email":
        sound = passes(kind, value)
    elif kind == "email":
        sound = "@" in value
    elif kind == "secret":
        sound = len(digits) >= 4 and sum(has(x, value) for x in ("[a-z]", "[A-Z]", "[0-9]")) >= 2
    else:
        sound = len(value) >= 8
    known = has(pii.GAZETTEER[kind], digits if kind == "card" else value)
    return (int(has(pii.STRICT[kind], value)), int(sound), 1 if known else -1 if kind == "secret" else 0, 1 if has(pii.BEFORE[kind], before) else -1, 0 if has(pii.AGAINST[kind], before) else -1)


def plain_em(counts):
    """Expectation-maximisation, vote by vote: {(kind, votes): posterior}."""
    out = {}
    for kind in {k for k, _ in counts}:
        rows = [(v, n) for (k, v), n in counts.items() if k == kind]
        post = {v: min(max((sum(x for x in v if x >= 0) + 1) / (sum(x >= 0 for x in v) + 2), 0.05), 0.95) for v, _ in rows}
        for _ in range(50):
            rate = {}
            for true, low, high in ((1, [8, 8, 8, 8, 9.8], 10), (0, [3] * 5, 10)):
                w = {v: n * (post[v] if true else 1 - post[v]) for v, n in rows}
                rate[true] = [(sum(w[v] * v[j] for v, _ in rows if v[j] >= 0) + low[j]) / (sum(w[v] for v, _ in rows if v[j] >= 0) + high) for j in range(5)]
            prior = (sum(n * post[v] for v, n in rows) + 5) / (sum(n for _, n in rows) + 10)
            for v, _ in rows:
                odds = prior / (1 - prior)
                for j in range(5):
                    if v[j] >= 0:
                        odds *= (rate[1][j] if v[j] else 1 - rate[1][j]) / (rate[0][j] if v[j] else 1 - rate[0][j])
                post[v] = odds / (1 + odds)
        out |= {(kind, v): p for v, p in post.items()}
    return out


def plain_spans(held):
    """All spans of each text by plain loops: candidates, votes, posteriors, a classifier fitted by full gradients."""
    found = []
    for i, t in enumerate(held):
        t = t or ""
        base = brute(t)
        for k, kind in enumerate(pii.KINDS):
            if kind in pii.NEEDS and pii.NEEDS[kind] not in t:
                continue
            last = 0
            for m in regex.finditer(pii.CANDIDATES[kind], t):
                gap, last = t[last : m.start()], m.end()
                if not any(b[1] == k and b[0] < m.end() and m.start() < b[2] for b in base):
                    n = len(re.sub("[^0-9]", "", m[0]))
                    found.append((i, m.start(), k, m.end(), plain_votes(kind, m[0], gap[-32:]), min(len(m[0]) // 12, 3), n * 3 // (len(m[0]) + 1)))
    post = plain_em(Counter((f[2], f[4]) for f in found))
    rows = Counter((f[2], f[4], f[5], f[6]) for f in found)
    names = lambda r: [("kind", r[0]), ("long", r[2]), ("digits", min(r[3], 3)), *[("vote", r[0], j, v) for j, v in enumerate(r[1])]]
    w, speed, mass = Counter(), Counter(), sum(n**0.5 for n in rows.values())
    for _ in range(300):
        g = Counter()
        for r, n in rows.items():
            p = 1 / (1 + math.exp(-sum(w[x] for x in names(r))))
            for x in names(r):
                g[x] += n**0.5 / mass * (p - post[r[0], r[1]])
        for x in {*g, *w}:
            speed[x] = 0.9 * speed[x] - 1.5 * (g[x] + 1e-4 * w[x])
            w[x] += speed[x]
    out = [list(brute(t)) for t in held]
    for i, a, k, b, votes, long, digits in found:
        if sum(w[x] for x in names((k, votes, long, digits))) >= 0:
            out[i].append((a, k, b))
    return [sorted(x) for x in out], post


def crowd():
    """Texts with true and false spans of all kinds, which overlap at times."""
    rnd = random.Random(9)
    n = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    make = [
        lambda: f"mail a{n(2)}@site.com", lambda: f"write to x[at]host{n(1)}[dot]org", lambda: f"version {n(1)}.{n(1)}.{n(2)}.{n(1)}", lambda: f"host 8.8.{n(2)}.{n(3)}",
        lambda: f"card 4{n(15)}", lambda: f"order {n(4)} {n(4)} {n(4)} {n(4)}", lambda: f"call ({n(3)}) {n(3)}-{n(4)}", lambda: f"+1 (578) 555-{n(4)} {n(16)}", lambda: f"page {n(3)} {n(3)} {n(4)}",
        lambda: f"token sk-{n(6)}abcdefgh{n(6)}", lambda: f"commit {n(20)}abcdef{n(14)}", lambda: f"ssn {n(3)}-{n(2)}-{n(4)}", lambda: f"part {n(3)}-{n(2)}-{n(4)}",
        lambda: f"dear Mr. {rnd.choice(pii.NAMES[:9])} Smith", lambda: "Herr Muster", lambda: "said Dr. No", lambda: f"1.2.3.4.5.{n(2)}", lambda: "prose and more of it",
    ]
    return [None, ""] + ["; ".join(rnd.choice(make)() for _ in range(rnd.randrange(1, 9))) for _ in range(150)]


def test_all_spans_equal_brute_force(spark):
    held = crowd()
    want, post = plain_spans(held)
    got = {r.doc_id: r.spans for r in pii.op4(frame(spark, held)).collect()}
    for i, spans in enumerate(want):
        assert got[i] == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans), held[i]
    assert {k for x in want for _, k, _ in x} == set(range(len(pii.KINDS)))
    assert {k for k, p in post.items() if p > 0.5} and {k for k, p in post.items() if p < 0.5}
    counts = Counter({k: 3 + len(k[1]) for k in post})
    ours = pii.reliabilities([(k, v, n) for (k, v), n in counts.items()])
    assert all(math.isclose(p, ours[k], abs_tol=1e-9) for k, p in plain_em(counts).items())
    # redaction: overlapping spans become one, under the first one's kind
    for r in pii.redact(frame(spark, held)).collect():
        text, out, at = held[r.doc_id], "", 0
        groups = []
        for a, k, b in want[r.doc_id]:
            if groups and a < groups[-1][2]:
                groups[-1][2] = max(groups[-1][2], b)
            else:
                groups.append([a, k, b])
        for a, k, b in groups:
            out, at = out + text[at:a] + f"<{pii.KINDS[k].upper()}>", b
        assert r.text == (None if text is None else out + text[at:])


def test_contact_lists_take_linear_time(spark):
    """Twenty thousand spans in one text, with candidates of the same kinds beside them."""
    import time

    one = lambda i: f"a{i}@b.co +49 30 {1234567 + i} or (555) 123-{i % 10000:04d} x{i}[at]y.org"
    took = []
    for n in (500, 2000, 16_000):
        df = frame(spark, [" é ".join(map(one, range(n)))])
        began = time.monotonic()
        row = pii.op4(df).first()
        assert row.n_email == n and row.n_phone == n
        assert pii.redact(df).first().text.startswith("<EMAIL> <PHONE> ")
        took.append(time.monotonic() - began)
    assert took[2] < 8 * took[1] + 5


def test_prefix_sums(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, pii.BLOCK, pii.BLOCK + 1, 5 * pii.BLOCK + 3):
        got = spark.range(1).select(pii.prefix_sums(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("s")).first().s
        assert got == [i * (i + 1) // 2 for i in range(n)]


# decontamination


def best(text, item):
    """Greatest stretch over all placements that share a seed."""
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    w, v, out = tok(text), tok(item), 0
    if len(v) < decontam.SPAN:  # a short item occurs whole, or not at all
        return len(v) if v and any(w[d : d + len(v)] == v for d in range(len(w))) else 0
    for d in range(-len(v), len(w)):
        if any(0 <= d + j and d + j + decontam.SPAN <= len(w) and j + decontam.SPAN <= len(v) and all(w[d + j + x] == v[j + x] for x in m) for m in decontam.MASKS for j in range(len(v) - decontam.SPAN + 1)):
            run = 0
            for j in range(len(v)):
                if 0 <= d + j < len(w):
                    run = max(0, run + (1 if w[d + j] == v[j] else decontam.MISS))
                    out = max(out, run)
    return out if v and out >= min(decontam.LEAST, -(-len(v) * 8 // 10)) else 0


@pytest.fixture(scope="module")
def leaks():
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(150)]
    items = [" ".join(rnd.choice(vocabulary) for _ in range(n)) for n in (40, 25, 12, 9, 8, 5, 1, 7)] + [None, "", "same " * 20]
    docs = []
    for _ in range(60):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randrange(60))]
        item = (rnd.choice(items[:6] + items[7:8])).split()
        for _ in range(rnd.randrange(4)):
            item[rnd.randrange(len(item))] = "sub"
        a, b = sorted((rnd.randrange(len(item) + 1), rnd.randrange(len(item) + 1))) if rnd.random() < 0.3 else (0, len(item))
        words[len(words) // 2 : len(words) // 2] = item[a:b]
        docs.append(" ".join(words).upper() + ".")
    return [*docs, None, "", items[0], items[4], "same " * 300], items


@pytest.mark.parametrize("most", [decontam.BROADCAST_SEEDS, 0])
def test_leaks_equal_brute_force(spark, leaks, most):
    docs, items = leaks
    bench = spark.createDataFrame([*enumerate(items), (0, "one more wording of w1"), (None, "an item without an id")], "item_id long, text string")
    rows = [*enumerate(docs), (3, docs[3]), (3, docs[5]), (None, docs[0]), (None, items[1]), (None, "here is an item without an id")]
    df = spark.createDataFrame([(i, t, 0, "k", "w") for i, t in rows], "doc_id long, text string, item_id int, key string, words string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontam.matches(df, bench, broadcast_seeds=most).collect()}
    want = {}
    for i, t in rows:
        for r in bench.collect():
            want[i, r.item_id] = max(best(t, r.text), want.get((i, r.item_id), 0))
    assert got == {k: v for k, v in want.items() if v} and (None, None) in got
    left = decontam.decontaminate(df, bench, broadcast_seeds=most)
    bad = {i for i, _ in got}
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(i for i, _ in rows if i not in bad)
    assert decontam.matches(df.limit(0), bench, broadcast_seeds=most).count() == 0 and decontam.matches(df, bench.limit(0), broadcast_seeds=most).count() == 0


@pytest.mark.parametrize("most", [decontam.BROADCAST_SEEDS, 0])
def test_very_long_texts(spark, most):
    """20,000 words: repeated ones that match an item everywhere, and ones with a passage near the end."""
    item, rnd = [f"i{j}" for j in range(40)], random.Random(1)
    prose = [f"w{rnd.randrange(500)}" for _ in range(20_000)]
    docs = ["same " * 20_000, " ".join([*prose[:19_000], *item, *prose[19_000:]]), " ".join(prose)] + [" ".join(prose[k : k + 12_000]) for k in range(6)]
    bench = spark.createDataFrame([(0, "same " * 40), (1, " ".join(item)), (2, "same same")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.matched, r.start) for r in decontam.matches(frame(spark, docs), bench, decontam.SHARE, most).collect()}
    assert got == {(0, 0, 40, 0), (0, 2, 2, 0), (1, 1, 40, 19_000)}


def test_short_items_with_substitutions(spark):
    """A fifth of an item's tokens substituted, at any places: found; one more: not by share."""
    items = [" ".join(f"i{n}x{j}" for j in range(n)) for n in (8, 10, 12, 14, 16, 20)]
    docs, want, rnd = [], set(), random.Random(6)
    for k, item in enumerate(items):
        n = len(item.split())
        for least in range(2):
            off = n - -(-n * 8 // 10) + least
            places = list(itertools.combinations(range(n), off))
            for some in rnd.sample(places, min(len(places), 60)):
                words = ["other" if j in some else w for j, w in enumerate(item.split())]
                if not least:
                    want.add((len(docs), k))
                docs.append("before it " + " ".join(words) + " after it")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.matches(frame(spark, docs), bench, decontam.SHARE).collect()}
    assert want <= got
    stretch = {(i, j) for i, t in enumerate(docs) for j, v in enumerate(items) if best(t, v)}
    assert got == want | stretch
    left = decontam.decontaminate(frame(spark, docs), bench, decontam.SHARE)
    assert {r.doc_id for r in left.collect()} == set(range(len(docs))) - {i for i, _ in got}


def test_planted_passages(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if plain(b.text) in plain(d.text)}
    assert want <= {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench).collect()}
    assert os.path.exists(DATA)

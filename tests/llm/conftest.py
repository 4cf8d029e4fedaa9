import random

import pytest

SYLLABLES = {"en": ["the", "ing", "th", "er", "on", "and", "wh", "sh"], "de": ["sch", "ung", "ein", "ich", "ß", "ge", "ver", "ö"]}


def prose(rnd, lang="en", words=60):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randrange(1, 4))) + rnd.choice(["", "", "", ",", "."]) for _ in range(words))


ODD = [None, "", "   \n\t ", "x", "a b", "日本語 テキスト 😀", "İ ſ ŉ \x00 \x1c é", "1234 5678", "word " * 3000, "z" * 20_000]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source) rows: two languages, junk, copies, near copies, odd texts."""
    rnd = random.Random(3)
    rows = []
    for i in range(90):
        lang = "en" if i % 2 else "de"
        text = prose(rnd, lang, rnd.randrange(30, 120))
        if i % 6 == 5:
            text = " | ".join(w + "$$$" for w in text.split())
        rows.append((i, text, lang, f"src{i % 3}"))
    for i in range(90, 100):
        rows.append((i, rows[i - 90][1], rows[i - 90][2], "copy"))
    for i in range(100, 112):
        words = rows[i - 100][1].split()
        words[len(words) // 2] = "changed"
        rows.append((i, " ".join(words), rows[i - 100][2], "near"))
    rows += [(200 + i, t, None, None) for i, t in enumerate(ODD)]
    rows += [(5, rows[5][1], "de", "src2"), (None, "a text without an id and some words", "en", None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, words string, base string, label int"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names operators use inside."""
    return spark.createDataFrame([(*r, len(r[1] or ""), 0.1, 1, "w", "b", 0) for r in corpus], SCHEMA)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)

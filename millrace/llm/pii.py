"""Personal data: fixed-pattern spans, and more spans by aggregating weak labelers. SQL functions only.

Base spans (email, ip, card, phone) are the leftmost non-overlapping matches of each kind's pattern
that pass its check; they always stay. A base match that fails its check hides what lies within it (a
phone number with a card number after it, say), and other kinds have no base pattern. So narrower patterns
propose candidates (email, ip, card, phone, secret, ssn, name), and five labelers vote on each: a strict
form, a checksum or composition, a gazetteer, and the words before it for and against.
Expectation-maximisation over the counts of vote patterns estimates the labelers' reliabilities by
kind and each pattern's posterior; a logistic span classifier over votes, length and digit share is
then trained on those posteriors and decides. Vote patterns are few whatever the corpus, so only their
counts reach the driver; the classifier runs as a column expression.

Positions come from a pattern's matches and the gaps between them, summed in blocks; overlaps come from one sorted
run over a kind's spans and candidates, and new texts from pieces of CUT characters: long texts
with many matches take about linear time. Patterns start only at a run's first character or where the last
match ended, and repeat possessively: the same matches as the plain patterns, without their quadratic cost.

Defined results: a null text counts as empty and has no spans. Rows are independent: repeated rows
repeat their results, a null doc_id stays null, other columns are ignored or kept by ``redact``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import document_columns, write_table

# The four base kinds in their listed order, as patterns equal to the plain ones
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this can't hold a base span of the kind.
BASE_NEEDS = {"email": "@", "ip": ".", "phone": "+"}
CANDIDATES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){2,3}(?:[\x20-][0-9]{1,3})?|3[0-9]{3}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])(?=[0-9_+/=-]*+[A-Za-z])[A-Za-z0-9_+/=-]{20,}+",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<!\p{L})(?:(?:Mr|Mrs|Ms|Dr|Prof|Sr|Sra|Dra)\.|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señora?)\x20\p{Lu}\p{Ll}++(?:\x20\p{Lu}\p{Ll}++)?+",
}
#: A text without this can't hold a candidate of the kind: it stands in every match of its pattern (which no sign does for email and phone).
NEEDS = {"ip": ".", "ssn": "-"}
STRICT = {
    "email": r"^[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$",
    "ip": r"^(?!0|127\.|255\.)[0-9.]+$",
    "card": r"^([0-9]{15,16}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4})$",
    "phone": r"^\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)|^\+[0-9]{1,3}[ .-][0-9]{3}[ .-]",
    "secret": r"^([0-9a-f]{32,}|[A-Z0-9]{20}|[A-Za-z]{2,6}[_-][A-Za-z0-9_-]{16,}|[A-Za-z0-9+/]{24,}={0,2})$",
    "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$",
    "name": r"^\p{Lu}\p{Ll}+\.? \p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+$",
}
# Given names common in English, German, French and Spanish
NAMES = (
    "Adam Alice Alan Andrew Anna Anne Anthony Barbara Brian Charles Christopher Daniel David Deborah Donald Edward Elizabeth Emily Emma "
    "George Helen Henry Jack James Jane Jennifer Jessica John Joseph Julia Karen Kevin Laura Linda Lisa Margaret Mark Mary Matthew Michael "
    "Nancy Oliver Patricia Paul Peter Rachel Richard Robert Ruth Samuel Sarah Sophie Steven Susan Thomas Victoria William "
    "Andreas Angelika Birgit Christian Claudia Dieter Elke Frank Franz Friedrich Fritz Gerhard Hans Heike Heinz Helga Jens Jonas Jürgen Karl "
    "Katrin Klaus Lena Lukas Martina Matthias Monika Petra Sabine Stefan Ursula Uwe Werner Wolfgang "
    "Antoine Camille Catherine Céline Chantal Claire Étienne François Françoise Gérard Hélène Isabelle Jacques Jean Julien Louis Luc Marc "
    "Marie Mathieu Michel Nathalie Nicolas Philippe Pierre Sylvie Thierry Yves "
    "Alejandro Ana Antonio Carlos Carmen Cristina Diego Elena Fernando Francisco Isabel Javier Jesús Jorge José Juan Lucía Luis Manuel María "
    "Miguel Pablo Pedro Pilar Rafael Rosa Sergio Teresa"
).split()
# Gazetteers: mail ends (generic ones, or a country's two letters), allocated address blocks, card issuers, country codes,
# key prefixes, area numbers in use, given names
GAZETTEER = {
    "email": r"(?i)\.(com|org|net|edu|gov|mil|int|info|biz|name|pro|app|dev|online|shop|site|tech|cloud|[a-z]{2})$",
    "ip": r"^(?!0\.|10\.|127\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.0\.[02]\.|192\.168\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.)([1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.",
    "card": r"^(4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|30[0-5]|3[689]|6011|64[4-9]|65|35(2[89]|[3-8])|62)",
    "phone": r"^\+(1|7|2[07]|21[1-368]|2[234569][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[013]|5[1-8]|5[09][0-9]|6[0-6]|6[789][0-9]|8[1246]|85[02356]|88[06]|9[0-58]|9[679][0-9])",
    "secret": r"^(AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live|pk_live|rk_live|xox[abprs]-|eyJ|SG\.|npm_|pypi-)",
    "ssn": r"^(?!000|666|73[4-9]|74)([0-6][0-9]{2}|7[0-6][0-9]|77[0-2])-",
    "name": rf" ({'|'.join(NAMES)})\b",
}
# Words before a span that speak for it and against it, in the same four languages; what may go on at length is tried from
# its run's first character only, so that a gap of any length takes linear time
BEFORE = {
    "email": r"(?i)(e-?mail|mail|contact|write|reach|kontakt|schreib|courriel|correo|contacto|(?<!\w)(?>\w*?escrib)\w*+)\W*$",
    "ip": r"(?i)(ip|addr(ess)?|host|from|client|server|adresse|rechner|serveur|direcci.n|servidor)\W*$",
    "card": r"(?i)(card|visa|mastercard|amex|credit|debit|payment|number|no|karte|kartennummer|carte|paiement|tarjeta|pago|n.mero)\W*$",
    "phone": r"(?i)(phone|tel|call|mobile|cell|fax|contact|ring|telefon|handy|mobil|anruf|t.l.phone|portable|tel.fono|m.vil|(?<!\w)(?>\w*?(?:appel|llam))\w*+)\W*$",
    "secret": r"(?i)(token|secret|passw(or)?d|pwd|api|key|auth|bearer|credential|passwort|kennwort|schl.ssel|mot de passe|cl.|contrase.a|clave)\W*$",
    "ssn": r"(?i)(ssn|social|security|tax|number|no|nummer|s.curit.|seguridad|n.mero|(?<!\w)(?>\w*?(?:sozial|steuer))\w*+)\W*$",
    "name": r"(?i)(dear|contact|by|from|attn|signed|patient|sincerely|with|to|liebe[r]?|geehrte[r]?|von|mit|cher|ch.re|par|avec|estimad[oa]|querid[oa]|por|con)\W*$",
}
AGAINST = {
    "email": r"(?i)(href|src|git)\W*$",
    "ip": r"(?i)(version|release|section|chapter|v|abschnitt|kapitel|chapitre|cap.tulo)\W*$",
    "card": r"(?i)(isbn|order|invoice|id|serial|timestamp|ticket|bestellung|rechnung|commande|facture|pedido|factura)\W*$|[0-9][.,]$",
    "phone": r"(?i)(id|isbn|version|order|figure|page|pages|seite|bestellung|commande|p.gina|pedido)\W*$|[0-9][.,]$",
    "secret": r"(?i)(commit|sha|sha1|sha256|md5|hash|digest|checksum|revision|blob|uuid)\W*$|(?<!\S)(?>\S*?https?://)\S*+$",
    "ssn": r"(?i)(part|model|order|item|version|artikel|art.culo)\W*$",
    "name": r"(?i)(street|avenue|university|institute|company|stra.e|universit.t|rue|universit.|calle|universidad)\W*$",
}
KINDS = [*BASE, "secret", "ssn", "name"]
N_VOTES = 5
BLOCK = 256
#: Characters of a piece that a text is cut to before spans are replaced in it.
CUT = 1024


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is made once a row, also where `f` uses it within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """What `add` makes of 0 and all elements before each one, of a non-empty array of longs; by blocks, so that it takes linear time."""
    zero = F.array(F.lit(0).cast("long"))

    def blocks(v: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return F.transform(places, lambda b: F.aggregate(F.slice(v, b * BLOCK + 1, F.lit(BLOCK)), zero, lambda acc, x: F.array_append(acc, add(F.element_at(acc, -1), x))))

    def joined(inner: Column) -> Column:
        offsets = F.aggregate(inner, zero, lambda acc, a: F.array_append(acc, add(F.element_at(acc, -1), F.element_at(a, -1))))
        return F.flatten(F.zip_with(inner, F.slice(offsets, F.lit(1), F.size(inner)), lambda a, o: F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda v: add(v, o))))

    return let(let(values, blocks), joined)


def prefix_sums(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def prefix_greatest(values: Column) -> Column:
    """The greatest element before each one, at least 0."""
    return running(values, lambda a, b: F.greatest(a, b))


def apart(df: DataFrame, name: str, kind: int) -> DataFrame:
    """Leave only those candidates in column `name` that overlap no base span of their kind.

    Base spans of a kind lie apart, so the last that starts before a candidate's end has the greatest end of
    those: one run over both, by start and by end, tells.
    """
    spans = F.filter("base", lambda b: b["kind"] == kind)
    none = F.lit(None).cast(df.schema[name].dataType.elementType)
    starts = F.transform(spans, lambda b: F.struct((2 * b["start"] + 1).alias("key"), b["end"].alias("end"), none.alias("c")))
    ends = F.transform(F.col(name), lambda c: F.struct((2 * c["end"]).alias("key"), F.lit(0).cast("long").alias("end"), c.alias("c")))
    both = F.exists("base", lambda b: b["kind"] == kind) & (F.size(name) > 0)
    df = df.withColumn("_e", F.when(both, F.sort_array(F.concat(starts, ends))))
    df = df.withColumn("_r", F.when(F.size("_e") > 0, prefix_greatest(F.transform("_e", lambda e: e["end"]))))
    free = F.filter(F.arrays_zip(F.col("_e").alias("e"), F.col("_r").alias("r")), lambda x: x["e"]["c"].isNotNull() & (x["r"] <= x["e"]["c"]["start"]))
    return df.withColumn(name, F.when(F.col("_e").isNull(), F.col(name)).otherwise(F.transform(free, lambda x: x["e"]["c"]))).drop("_e", "_r")


def matched(df: DataFrame, name: str, pattern: str, needs: str | None) -> DataFrame:
    """Add `name`: the pattern's matches as (start, end, value, before), in code points from 0; before is the whole gap since the last match."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    df = df.withColumn("_m", F.when(F.contains("text", F.lit(needs)), found).otherwise(none) if needs else found)
    df = df.withColumn("_g", F.when(F.size("_m") > 0, F.split("text", pattern, -1)))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, prefix_sums(F.zip_with(F.slice("_g", 1, F.size("_m")), "_m", lambda g, m: (F.length(g) + F.length(m)).cast("long")))))
    rows = F.transform(
        F.arrays_zip(F.col("_m").alias("m"), F.slice("_g", 1, F.size("_m")).alias("g"), F.col("_p").alias("p")),
        lambda x: F.struct(
            (x["p"] + F.length(x["g"])).alias("start"), (x["p"] + F.length(x["g"]) + F.length(x["m"])).alias("end"), x["m"].alias("value"), x["g"].alias("before"),
        ),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string>>")
    return df.withColumn(name, F.coalesce(F.when(F.size("_m") > 0, rows), empty)).drop("_m", "_g", "_p")


def _with(f: Callable, *args: object) -> Callable[[Column], Column]:
    """A lambda of one column; higher-order functions count a lambda's parameters."""
    return lambda s: f(s, *args)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


#: A part of at most 255, leading zeros aside.
_PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def passes(kind: str, value: Column) -> Column:
    """The base kind's check."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_PART}(\.{_PART}){{3}}$")
    n = F.length(_digits(value))
    return n.between(9, 15) if kind == "phone" else n.between(12, 19) & F.call_function("luhn_check", _digits(value))


def sound(kind: str, value: Column) -> Column:
    """The second labeler: a checksum, or what the value is made of."""
    if kind in ("ip", "card", "phone"):
        return passes(kind, value)
    if kind == "email":
        return value.contains("@")
    if kind == "secret":
        kinds = sum(value.rlike(p).cast("int") for p in ("[a-z]", "[A-Z]", "[0-9]"))
        return (F.length(F.regexp_replace(value, "[^0-9]", "")) >= 4) & (kinds >= 2)
    return F.length(value) >= 8


def scanned(docs: DataFrame) -> DataFrame:
    """`docs` (with a text column) and `base` and `tried`: base spans, and candidates with their votes."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    for kind, pattern in BASE.items():
        df = matched(df, f"_{kind}", pattern, BASE_NEEDS.get(kind))
        df = df.withColumn(f"_{kind}", F.filter(F.col(f"_{kind}"), _with(lambda s, k: passes(k, s["value"]), kind)))
    kinds = [F.transform(F.col(f"_{k}"), _with(lambda s, i: F.struct(s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")), i)) for i, k in enumerate(BASE)]
    df = df.withColumn("base", F.sort_array(F.concat(*kinds))).drop(*[f"_{k}" for k in BASE])
    votes = []
    for i, kind in enumerate(KINDS):
        df = matched(df, f"_{kind}", CANDIDATES[kind], NEEDS.get(kind))

        def voted(s: Column, kind: str, i: int) -> Column:
            value, before = s["value"], s["before"]
            plain = _digits(value) if kind == "card" else value
            yes = lambda c: F.when(c, 1).otherwise(0)
            return F.struct(
                s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end"),
                F.array(yes(value.rlike(STRICT[kind])), yes(sound(kind, value)), F.when(plain.rlike(GAZETTEER[kind]), 1).otherwise(-1 if kind == "secret" else 0), F.when(before.rlike(BEFORE[kind]), 1).otherwise(-1), F.when(before.rlike(AGAINST[kind]), 0).otherwise(-1)).alias("votes"),
                F.least(F.floor(F.length(value) / 12), F.lit(3)).cast("int").alias("long"),
                F.floor(F.length(_digits(value)) * 3 / (F.length(value) + 1)).cast("int").alias("digits"),
            )

        if kind in BASE:  # a candidate within or across a base span of its kind adds nothing
            df = apart(df, f"_{kind}", i)
        votes.append(F.transform(F.col(f"_{kind}"), _with(voted, kind, i)))
    return df.withColumn("tried", F.concat(*votes)).drop(*[f"_{k}" for k in KINDS])


def reliabilities(counts: list[tuple[int, tuple[int, ...], int]], rounds: int = 50) -> dict[tuple[int, tuple[int, ...]], float]:
    """Posterior of each (kind, votes) by expectation-maximisation; votes are 1, 0 or -1 (abstains).

    Each labeler has by kind a rate of voting 1 among true spans and among others, with a Beta prior
    that it is better than chance, so the two classes can't change places.
    """
    out = {}
    for kind in sorted({k for k, _, _ in counts}):
        rows = [(np.array(v), n) for k, v, n in counts if k == kind]
        votes, n = np.array([v for v, _ in rows]), np.array([x for _, x in rows], float)
        said = votes >= 0
        post = np.clip((np.where(said, votes, 0).sum(1) + 1) / (said.sum(1) + 2), 0.05, 0.95)
        for _ in range(rounds):
            w1, w0 = (n * post)[:, None] * said, (n * (1 - post))[:, None] * said
            p1 = ((w1 * votes).sum(0) + np.array([8, 8, 8, 8, 9.8])) / (w1.sum(0) + 10)  # a labeler against is seldom wrong
            p0 = ((w0 * votes).sum(0) + 3) / (w0.sum(0) + 10)
            prior = ((n * post).sum() + 5) / (n.sum() + 10)
            ll = lambda p: np.where(said, np.where(votes == 1, np.log(p), np.log(1 - p)), 0).sum(1)
            post = 1 / (1 + np.exp(np.clip(ll(p0) - ll(p1) + np.log((1 - prior) / prior), -50, 50)))
        out |= {(kind, tuple(int(x) for x in v)): float(p) for (v, _), p in zip(rows, post, strict=True)}
    return out


def _vector(kind: int, votes: tuple[int, ...], long: int, digits: int) -> np.ndarray:
    x = np.zeros(len(KINDS) * (1 + N_VOTES * 3) + 4 + 4)
    base = kind * (1 + N_VOTES * 3)
    x[base] = 1
    for j, v in enumerate(votes):
        x[base + 1 + 3 * j + v + 1] = 1
    x[-8 + min(long, 3)] = x[-4 + min(max(digits, 0), 3)] = 1
    return x


def classifier(rows: list[tuple[int, tuple[int, ...], int, int, int]], rounds: int = 300) -> np.ndarray:
    """Weights of a logistic classifier trained on the posteriors; rows: kind, votes, long, digits, count."""
    if not rows:
        return np.zeros(len(_vector(0, (), 0, 0)))
    merged: dict[tuple[int, tuple[int, ...]], int] = {}
    for k, v, _, _, n in rows:
        merged[k, v] = merged.get((k, v), 0) + n
    post = reliabilities([(k, v, n) for (k, v), n in sorted(merged.items())])
    x = np.array([_vector(*r[:4]) for r in rows])
    y = np.array([post[r[0], r[1]] for r in rows])
    n = np.sqrt(np.array([r[4] for r in rows], float))  # common patterns must not drown the rest
    n /= n.sum()
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for _ in range(rounds):
        g = x.T @ (n * (1 / (1 + np.exp(-np.clip(x @ w, -35, 35))) - y)) + 1e-4 * w
        speed = 0.9 * speed - 1.5 * g
        w = w + speed
    return w


def train(tried: DataFrame) -> np.ndarray:
    """Count vote patterns (at most kinds x 3**5 x 16 of them) and fit the classifier."""
    counts = tried.select(F.explode("tried").alias("c")).groupBy("c.kind", "c.votes", "c.long", "c.digits").count().collect()
    return classifier(sorted((r["kind"], tuple(r["votes"]), r["long"], r["digits"], r["count"]) for r in counts))


def accepted(weights: np.ndarray, c: Column) -> Column:
    """The classifier as an expression over a candidate."""
    wide = 1 + N_VOTES * 3
    table = F.array(*[F.lit(float(round(x, 6))) for x in weights])
    at = lambda i: F.element_at(table, (i + 1).cast("int"))
    base = c["kind"] * wide
    total = at(base) + at(F.lit(len(weights) - 8) + c["long"]) + at(F.lit(len(weights) - 4) + F.least(c["digits"], F.lit(3)))
    for j in range(N_VOTES):
        total = total + at(base + 2 + 3 * j + F.element_at(c["votes"], j + 1))
    return total >= 0


def with_spans(found: DataFrame, weights: np.ndarray) -> DataFrame:
    """Add `all_spans`: base spans and accepted candidates by start, then kind."""
    more = F.transform(F.filter("tried", lambda c: accepted(weights, c)), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return found.withColumn("all_spans", F.sort_array(F.concat("base", more)))


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4(docs: DataFrame) -> DataFrame:
    found = write_table(scanned(document_columns(docs, "doc_id", "text")).select("doc_id", "base", "tried"), "pii")
    done = with_spans(found, train(found))
    counts = [F.size(F.filter("base", _with(lambda s, i: s["kind"] == i, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return done.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("all_spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The columns of `docs`, each span in text replaced by its kind's name in angle brackets.

    Spans that overlap become one, under the first one's kind. A null text stays null.
    """
    found = write_table(scanned(docs.withColumn("_was", F.col("text"))), "pii")
    done = with_spans(found, train(found))
    # a span begins a new group where all before it have ended; a group ends where its last span does
    ends = F.transform("all_spans", lambda s: s["end"])
    done = done.withColumn("_before", F.when(F.size("all_spans") > 0, prefix_greatest(ends)))
    done = done.withColumn("_heads", F.filter(F.arrays_zip(F.col("all_spans").alias("s"), F.col("_before").alias("m")), lambda x: x["s"]["start"] >= x["m"]))
    until = F.concat(F.slice(F.transform("_heads", lambda h: h["m"]), F.lit(2), F.size("_heads") - 1), F.array(F.array_max(ends)))
    done = done.withColumn("_spans", F.when(F.size("all_spans") > 0, F.zip_with("_heads", until, lambda h, e: F.struct(h["s"]["start"].alias("start"), h["s"]["kind"].alias("kind"), e.alias("end")))))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def part(cut: Column, a: Column, b: Column) -> Column:
        """Characters a to b of the text, from the pieces that hold them."""
        first, last = F.floor(a / CUT).cast("int"), F.floor((b - 1) / CUT).cast("int")
        held = F.array_join(F.slice(cut, first + 1, last - first + 1), "")
        return F.when(a < b, F.substr(held, (a - first * CUT + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    gaps = lambda cut: F.zip_with(
        F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("end"))), F.col("_spans")),
        F.concat(F.transform("_spans", lambda s: s["start"]), F.array(F.length("text").cast("long"))),
        lambda s, to: F.concat(F.when(s["kind"] >= 0, F.element_at(names, s["kind"] + 1)).otherwise(""), part(cut, s["end"], to)),
    )
    cuts = let(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0)), gaps)
    changed = F.when(F.col("_was").isNull(), None).when(F.size("_spans") > 0, F.array_join(cuts, "")).otherwise(F.col("text"))
    return done.withColumn("text", changed).select(*docs.columns)



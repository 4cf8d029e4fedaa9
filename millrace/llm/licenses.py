"""License scans by sentence-rule recognition. SQL functions only.

A text's sentences are normalised to lower-case words and looked up among known licence sentences, of which
several wordings may have one identifier; a licence rule is an ordered sequence of identifiers, found where the recognised sentences of a
text follow each other in that order. Sentences are cut twice, at line ends as well as sentence ends
and at sentence ends alone, so a notice may stand in a line of its own and a full licence may be
wrapped. A rule that holds another found rule's sequence takes its place. All happens in a text's own
row: no shuffle, and a text is only cut if it has a word that every rule needs.

A book of sentences and rules is a parameter. BOOK has the texts, headers, notices and SPDX tags below; ``with_text`` adds a
licence by its full text, sentence by sentence.

Defined results: one row for each licence found in a document's row, so repeated rows repeat theirs;
null and empty texts give none. A null doc_id stays null. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import document_columns

# Known licence sentences, in plain normal form (lower-case words, single spaces)
SENTENCES = {
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is-short": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-law": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-free2": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
    "apache-copys": "you may obtain a copy of the license at https www apache org licenses license 2 0",
    "mpl-copys": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "bsd-university": "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-owner": "neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gnu-program": "this program is free software",
    "gnu-library": "this library is free software",
    "gnu-hope1": "this program is distributed in the hope that it will be useful but without any warranty",
    "gnu-hope2": "without even the implied warranty of merchantability or fitness for a particular purpose",
    "unlicense-do": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "wtfpl": "you just do what the fuck you want to",
    "wtfpl-name": "do what the fuck you want to public license",
}
# Names that a notice or an SPDX tag may give a licence, in the same form
NAMES = {
    "MIT": ("mit license", "mit licence", "expat license", "mit"),
    "Apache-2.0": ("apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mpl 2 0"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause"),
    "ISC": ("isc license", "isc"),
    "Unlicense": ("unlicense", "unlicense license"),
    "Zlib": ("zlib license", "zlib"),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0", "bsl 1 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v 2 0", "epl 2 0"),
    "EUPL-1.2": ("european union public license 1 2", "european union public licence v 1 2", "eupl 1 2"),
    "Artistic-2.0": ("artistic license 2 0", "artistic 2 0"),
    "WTFPL": ("wtfpl license", "wtfpl"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal license", "creative commons zero v1 0 universal"),
}
#: How a notice leads up to a licence's name, in four languages and the same form; all of it stands for "under".
LEAD = (
    "^(?:(?:this (?:project|software|work|file|code|library|program|package|repository) is )?(?:licensed|released|distributed|available|published|provided) under (?:the terms of )?(?:the |a |an )?"
    "|(?:dieses projekt steht|lizenziert) unter der |(?:ce projet est )?sous licence |(?:licenciado|este proyecto est) bajo la (?:licencia )?)"
)


def _named() -> dict[str, tuple[str, ...]]:
    """All licences' names: those above, and those that follow from a family's parts and versions."""
    out = dict(NAMES)
    for family, short, versions in (("general", "gpl", ("2.0", "3.0")), ("lesser general", "lgpl", ("2.1", "3.0")), ("affero general", "agpl", ("3.0",))):
        for v in versions:
            n, whole = v.replace(".", " "), v.removesuffix(".0").replace(".", " ")
            long = f"gnu {family} public license"
            out[f"{short.upper()}-{v}"] = tuple(dict.fromkeys([*(f"{long} {x}" for x in (f"version {whole}", f"version {n}", f"v{whole}", f"v{n}")), f"gnu {short} v{whole}", f"{short} v{whole}", f"{short}v{whole}", f"{short} {n}", f"{short} {n} only"]))
            out[f"{short.upper()}-{v}-or-later"] = (f"{short} {n} or later", f"{long} version {whole} or later", f"{long} v{n} or later")
    words = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
    for parts in ("by", "by sa", "by nc", "by nc sa", "by nd", "by nc nd"):
        for v in ("3.0", "4.0"):
            n, long = v.replace(".", " "), " ".join(words[x] for x in parts.split())
            out[f"CC-{parts.upper().replace(' ', '-')}-{v}"] = (f"cc {parts} {n}", f"cc {parts} {n} license", *(f"creative commons {long} {n} {x}" for x in ("license", "international license", "unported license", "international")))
    return out


@dataclass(frozen=True)
class Book:
    """Identifiers by sentence, and rules of (licence, rule, ordered identifiers)."""

    sentences: dict[str, str]
    rules: tuple[tuple[str, str, tuple[str, ...]], ...]

    @property
    def numbers(self) -> dict[str, int]:
        return {k: i for i, k in enumerate(dict.fromkeys(self.sentences.values()))}

    def sequence(self, rule: tuple[str, ...]) -> str:
        known = self.numbers
        return "".join(f",{known[x]}," for x in rule)

    def with_text(self, licence: str, text: str) -> Book:
        """A book that knows a licence's full text too: all its sentences of four words or more, in order."""
        cut = re.sub(r"([.!?:;])[ \t\r]+", r"\1\n", text.replace("\n", " ")).split("\n")
        plain = [x for c in cut if len((x := re.sub(LEAD, "under ", re.sub("[^a-z0-9]+", " ", c.lower()).strip())).split()) >= 4]
        held = dict(self.sentences)
        ids = tuple(held.setdefault(x, f"{licence}#{i}") for i, x in enumerate(plain))
        return Book(held, (*self.rules, (licence, "text", ids)))

    def longer(self) -> dict[int, list[int]]:
        """For each rule, the rules whose sequence holds its own and more."""
        made = [self.sequence(r[2]) for r in self.rules]
        return {i: [j for j, b in enumerate(made) if i != j and a in b and len(b) > len(a)] for i, a in enumerate(made)}


def _book() -> Book:
    held = {s: k for k, s in SENTENCES.items()}
    held |= {SENTENCES[k]: one for one, *more in (("apache-copy", "apache-copys"), ("mpl-copy", "mpl-copys"), ("bsd-endorse", "bsd-university", "bsd-owner"), ("gnu-program", "gnu-library")) for k in more}
    held["spdx license identifier"] = "spdx"
    rules = [
        ("MIT", "text", ("mit-grant", "mit-notice", "as-is-short", "mit-liability")),
        ("MIT", "grant", ("mit-grant",)),
        ("Apache-2.0", "header", ("notice:Apache-2.0", "apache-use", "apache-copy", "apache-law", "apache-see")),
        ("GPL-3.0-or-later", "header", ("gpl-free", "gpl-hope", "gpl-see")),
        ("GPL-2.0-or-later", "header", ("gpl-free2", "gpl-hope", "gpl-see")),
        ("GPL-3.0-or-later", "grant", ("gpl-free",)),
        ("GPL-2.0-or-later", "grant", ("gpl-free2",)),
        ("MPL-2.0", "header", ("mpl-form", "mpl-copy")),
        ("MPL-2.0", "notice", ("mpl-form",)),
        ("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
        ("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary")),
        ("ISC", "text", ("isc-grant", "isc-as-is")),
        ("Unlicense", "text", ("unlicense", "unlicense-do")),
        ("Unlicense", "notice", ("unlicense",)),
        ("Zlib", "text", ("zlib-as-is", "zlib-liable", "zlib-grant")),
        ("BSL-1.0", "text", ("boost-grant",)),
        ("WTFPL", "text", ("wtfpl",)),
        ("WTFPL", "notice", ("wtfpl-name",)),
        ("all-rights-reserved", "notice", ("reserved",)),
    ]
    for family, short, versions in (("general", "GPL", ("2", "3")), ("lesser general", "LGPL", ("2.1", "3")), ("affero general", "AGPL", ("3",))):
        may = f"you can redistribute it and or modify it under the terms of the gnu {family} public license as published by the free software foundation"
        held[may] = f"{short}-may"
        for v in versions:
            either = f"either version {v.replace('.', ' ')} of the license or at your option any later version"
            held[either], held[f"{may} {either}"] = f"either-{v}", f"{short}-may-{v}"
            full = f"{short}-{v}" + (".0" if "." not in v else "") + "-or-later"
            rules += [(full, "header", ("gnu-program", f"{short}-may-{v}", "gnu-hope1", "gnu-hope2")), (full, "header", ("gnu-program", f"{short}-may", f"either-{v}", "gnu-hope1", "gnu-hope2"))]
            rules += [(full, "grant", ("gnu-program", f"{short}-may-{v}")), (full, "grant", ("gnu-program", f"{short}-may", f"either-{v}"))]
    for licence, names in _named().items():
        tag = re.sub("[^a-z0-9]+", " ", licence.lower())
        # by itself a name is a notice where it names a licence, and an SPDX tag's else
        held |= {form + n: f"notice:{licence}" for n in names for form in ("under ", "the ", "") if form == "under " or "licen" in n}
        held[tag] = held.get(tag, f"tag:{licence}")
        held[f"spdx license identifier {tag}"] = f"spdx:{licence}"
        rules += [(licence, "notice", (f"notice:{licence}",)), (licence, "spdx", ("spdx", held[tag])), (licence, "spdx", (f"spdx:{licence}",))]
    return Book(held, tuple(rules))


BOOK = _book()
#: Every wording of a rule's rarest sentence has one of these.
TRIGGER = "licen|lizen|permission|redistribut|unencumbered|reserved|do what the fuck|(?:released|distributed|available|published|provided) under|steht unter|proyecto est. bajo"


def _recognised(text: Column, book: Book) -> Column:
    """The identifiers of a text's known sentences in order, as `,1,,2,`."""
    numbers = book.numbers
    known = F.from_json(F.lit(json.dumps({s: str(numbers[k]) for s, k in book.sentences.items()})), "map<string,string>")  # folded to one constant
    plain = F.transform(F.split(text, "\n"), lambda s: F.regexp_replace(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")), LEAD, "under "))
    ids = F.filter(F.transform(plain, lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull())
    return F.concat(F.lit(","), F.array_join(ids, ",,"), F.lit(","))


def scan(docs: DataFrame, book: Book = BOOK) -> DataFrame:
    """(doc_id, license, rule, sentences, found): `found` counts the rule's places in the text."""
    df = document_columns(docs, "doc_id", "text").where(F.lower("text").rlike(TRIGGER))
    ends = r"([.!?:;])[ \t\r]+"
    df = df.withColumn("by_line", _recognised(F.regexp_replace("text", ends, "$1\n"), book))
    df = df.withColumn("wrapped", _recognised(F.regexp_replace(F.regexp_replace("text", "\n", " "), ends, "$1\n"), book))
    df = df.where((F.length("by_line") > 2) | (F.length("wrapped") > 2))

    def places(column: str, sequence: str) -> Column:
        return ((F.length(column) - F.length(F.replace(F.col(column), F.lit(sequence), F.lit("")))) / len(sequence)).cast("int")

    made = [book.sequence(r[2]) for r in book.rules]
    df = df.withColumn("counts", F.array(*[F.greatest(places("by_line", x), places("wrapped", x)) for x in made]))
    longer = book.longer()
    rows = F.array(*[
        F.struct(F.lit(name).alias("license"), F.lit(rule).alias("rule"), F.lit(len(ids)).alias("sentences"),
                 F.greatest(F.get("counts", F.lit(i)) - sum((F.get("counts", F.lit(j)) for j in longer[i]), F.lit(0)), F.lit(0)).alias("found"))
        for i, (name, rule, ids) in enumerate(book.rules)
    ])
    each = df.select("doc_id", F.explode_outer(F.filter(rows, lambda r: r["found"] > 0)).alias("r"))  # outer: no filter is derived that repeats all this
    return each.where("r is not null").select("doc_id", "r.license", "r.rule", "r.sentences", "r.found")


def op5_sql(book: Book = BOOK) -> str:
    """The same scan in DuckDB's SQL."""
    numbers = book.numbers
    known = ", ".join(f"'{s}': '{numbers[k]}'" for s, k in book.sentences.items())
    ends = r"([.!?:;])[ \t\r]+"

    def ids(text: str) -> str:
        plain = f"list_transform(string_split(regexp_replace({text}, '{ends}', '\\1' || chr(10), 'g'), chr(10)), lambda s: regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), '{LEAD}', 'under '))"
        return f"',' || array_to_string(list_filter(list_transform({plain}, lambda s: (MAP {{{known}}})[s]), lambda i: i IS NOT NULL), ',,') || ','"

    def places(column: str, seq: str) -> str:
        return f"(length({column}) - length(replace({column}, '{seq}', ''))) // {len(seq)}"

    longer, made = book.longer(), [book.sequence(r[2]) for r in book.rules]
    counts = ", ".join(f"greatest({places('by_line', x)}, {places('wrapped', x)}) AS c{i}" for i, x in enumerate(made))
    rows = " UNION ALL ".join(
        f"SELECT doc_id, '{name}' AS license, '{rule}' AS rule, CAST({len(seq)} AS INTEGER) AS sentences, CAST(c{i}{''.join(f' - c{j}' for j in longer[i])} AS INTEGER) AS found FROM counted WHERE c{i}{''.join(f' - c{j}' for j in longer[i])} > 0"
        for i, (name, rule, seq) in enumerate(book.rules)
    )
    return (
        f"WITH cut AS (SELECT doc_id, {ids('text')} AS by_line, {ids('replace(text, chr(10), chr(32))')} AS wrapped FROM documents WHERE regexp_matches(lower(text), '{TRIGGER}')), "
        f"counted AS MATERIALIZED (SELECT doc_id, {counts} FROM cut WHERE length(by_line) > 2 OR length(wrapped) > 2) {rows}"
    )

"""Licence recognition by sentence rules.

A text is cut into pieces at line ends and after full stops; a piece is normalised to lower-case ASCII
letters and digits parted by single spaces. A sentence ends at a full stop, a blank line or a list mark: pieces
parted only by a single line end, or by an abbreviation's stop, belong to one sentence, so a wrapped text reads as an
unwrapped one. Known licence sentences have identifiers and are one piece or several neighbouring ones of a
sentence; the identifiers found in a text, in order, are matched against rules: a rule is an ordered list of
identifiers, of which neighbours may be at most ``GAP`` sentences apart. Places are numbers of pieces. All of it works
inside a row on built-in functions; no row leaves its partition, so a text's length and the number of copies make no
difference.

Defined cases: null and empty texts give no rows; a text that states a licence several times gives one row
for it with the number of statements; a known sentence inside a longer known one is not counted; repeated rows each give their rows; a null doc_id is carried.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Other sentences that may stand between two sentences of a rule.
GAP = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Identifiers of known sentences, and the sentences after normalisation.
SENTENCES = {
    "apache_use": ["you may not use this file except in compliance with the license"],
    "apache_copy": ["you may obtain a copy of the license at http www apache org licenses license 2 0", "you may obtain a copy of the license at"],
    "apache_basis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit_as_is": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "bsd_redist": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "boost_grant": ["permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "reserved": ["all rights reserved"],
}

#: Licences that sentences name: words of their names, versions that they are named by, and identifiers of
#: these. Without a version the first identifier is meant where ``None`` is among the versions.
NAMES = [
    ("mit no attribution|mit 0", {None: "MIT-0"}), ("mit|expat", {None: "MIT"}), ("x11", {None: "X11"}), ("isc", {None: "ISC"}), ("zlib|zlib libpng", {None: "Zlib"}), ("boost software|boost|bsl boost", {None: "BSL-1.0", "1": "BSL-1.0"}),
    ("apache(?: software)?|asl", {"2": "Apache-2.0", "1 1": "Apache-1.1"}), ("gnu general public|gnu gpl|general public|gpl", {"1": "GPL-1.0", "2": "GPL-2.0", "3": "GPL-3.0"}),
    ("gnu (?:lesser|library) general public|lesser general public|gnu lgpl|lgpl", {"2": "LGPL-2.0", "2 1": "LGPL-2.1", "3": "LGPL-3.0"}), ("gnu affero general public|affero general public|gnu agpl|agpl", {"1": "AGPL-1.0", "3": "AGPL-3.0"}),
    ("gnu free documentation|gfdl", {"1 1": "GFDL-1.1", "1 2": "GFDL-1.2", "1 3": "GFDL-1.3"}), ("mozilla public|mpl", {"1": "MPL-1.0", "1 1": "MPL-1.1", "2": "MPL-2.0"}), ("eclipse public|epl", {"1": "EPL-1.0", "2": "EPL-2.0"}),
    ("common development and distribution|cddl", {"1": "CDDL-1.0", "1 1": "CDDL-1.1"}), ("european union public|eupl", {"1 1": "EUPL-1.1", "1 2": "EUPL-1.2"}), ("open software|osl", {"3": "OSL-3.0"}), ("academic free|afl", {"3": "AFL-3.0"}),
    ("bsd 2 clause|2 clause bsd|simplified bsd|freebsd|two clause bsd|bsd two clause", {None: "BSD-2-Clause"}), ("bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd|three clause bsd|bsd three clause", {None: "BSD-3-Clause"}),
    ("bsd 4 clause|4 clause bsd|original bsd", {None: "BSD-4-Clause"}), ("bsd zero clause|zero clause bsd|0bsd", {None: "0BSD"}), ("artistic", {"1": "Artistic-1.0", "2": "Artistic-2.0"}), ("unlicense", {None: "Unlicense"}),
    ("wtfpl|do what the fuck you want to public", {None: "WTFPL", "2": "WTFPL"}), ("sil open font|open font|ofl", {"1": "OFL-1.0", "1 1": "OFL-1.1"}), ("python software foundation|psf", {None: "PSF-2.0", "2": "PSF-2.0"}), ("postgresql", {None: "PostgreSQL"}),
    ("university of illinois ncsa open source|ncsa", {None: "NCSA"}), ("microsoft public|ms pl", {None: "MS-PL"}), ("microsoft reciprocal|ms rl", {None: "MS-RL"}), ("business source|busl", {"1 1": "BUSL-1.1"}), ("server side public|sspl", {None: "SSPL-1.0", "1": "SSPL-1.0"}),
    ("open database|odbl|odc odbl", {None: "ODbL-1.0", "1": "ODbL-1.0"}), ("open data commons attribution|odc by", {None: "ODC-By-1.0", "1": "ODC-By-1.0"}), ("cecill", {"2": "CECILL-2.0", "2 1": "CECILL-2.1"}), ("ibm public|ipl", {"1": "IPL-1.0"}),
    ("cc0|creative commons zero|cc zero|creative commons cc0", {None: "CC0-1.0", "1": "CC0-1.0"}),
]
#: Creative Commons' licences by their parts and versions.
for _code, _words in (("BY", "attribution"), ("BY-SA", "attribution share ?alike"), ("BY-NC", "attribution non ?commercial"), ("BY-ND", "attribution no ?deriv(?:ative)?s(?: works)?"), ("BY-NC-SA", "attribution non ?commercial share ?alike"), ("BY-NC-ND", "attribution non ?commercial no ?deriv(?:ative)?s(?: works)?")):
    _short = _code.lower().replace("-", " ")
    NAMES.append((f"creative commons {_words}|cc {_words}|creative commons {_short}|cc {_short}", {f"{v}": f"CC-{_code}-{v}.0" for v in (1, 2, 3, 4)} | {"2 5": f"CC-{_code}-2.5"}))

#: How a sentence says that something is under a licence.
UNDER = (
    r"(?:(?:[a-z0-9]+ ){1,8}(?:is|are|may be|can be)(?: also| dual| free)? )?"
    r"(?:licen[sc]ed|released|distributed|available|published|provided|shared|made available|open sourced|redistributed|used|subject to|dedicated to the public domain|covered|governed)"
    r"(?: under| by| in accordance with| according to)?(?: the)?(?: terms(?: and conditions)? of)?(?: the| an?)? "
)
LEADS = rf"(?:{UNDER}|spdx licen[sc]e identifier |licen[sc]e (?:is )?(?:the )?|under (?:the )?(?:terms of )?(?:the )?|the |an? )?"
VERSION = r"(?:(?: version| ver| v)? ?v?([0-9](?: [1-9])?)(?: 0)?)?"
TAIL = rf"(?: (?:public )?licen[sc]e)?{VERSION}(?: (?:international|unported|generic))?(?: public)?(?: licen[sc]e)?(?: (?:only|or later|or (?:at your option )?any later(?: version)?))?(?: mit| isc)?(?: the licen[sc]e)?"
FREE = r"this [a-z]+(?: [a-z]+)? is free software (?:you can|you may) redistribute it and or modify it under the terms of the "
PUBLISHED = r" licen[sc]e as published by the free software foundation (?:either )?version ([0-9](?: [1-9])?)(?: 0)? of the licen[sc]e(?: or at your option any later version)?"
#: A sentence that names a licence: (number of its name, version) are found by what name and version it matches.
ANY = "|".join(names for names, _ in NAMES)
REFERENCE = rf"^{LEADS}({ANY}){TAIL}$"
GRANTED = rf"^{FREE}({ANY}){PUBLISHED}$"
#: Words of sentences that deny or condition what they say, so name no licence.
DENIED = r"(?:^| )(?:not|never|neither|nor|longer|unless|if|whether|instead)(?: |$)"
#: What a text holds that has a sentence that names a licence.
HINTED = rf"(?:^| )(?:{ANY})(?:v[0-9]| |$)"


#: One of these stands in every sentence that is known, and in one that names a licence: a name alone is none.
UNDER_NAMES = ("terms", "mit", "apache", "gnu", "bsd", "mozilla", "mpl", "eclipse", "epl", "boost", "isc", "zlib", "artistic", "eupl", "x11", "psf", "ofl", "odbl", "cc")
NAMING = ["licen", "spdx", "gpl", "creative commons", "cc by", "cc-by", "cc0"] + [f"under {the}{name}" for the in ("", "the ") for name in UNDER_NAMES]
TELLING = ["permission", "copies", "warrant", "redistribut", "compliance", "provided", "domain", "reserved", "endorse", *NAMING]
SAYS = "|".join(w.replace("-", " ") for w in NAMING)
#: The same in a sentence whose lines are still parted: a name's words may stand on two of them.
HINTED_LINES = r"[:\n ](?:" + ANY.replace(" ?", "(?: |\n[0-9]+:)?").replace(" ", r"(?: |\n[0-9]+:)") + r")(?:v[0-9]|[ \n])"


def named() -> list[tuple[str, str, str]]:
    """(pattern of the name, version or nothing, identifier) of every licence that the grammar knows."""
    return [(f"^(?:{names})$", version or "", licence) for names, versions in NAMES for version, licence in versions.items()]


#: Licences and their rules, ordered lists of identifiers. ``ref:`` and a licence is a rule of its own each.
RULES = {
    "Apache-2.0": ["apache_use", "apache_copy", "apache_basis"],
    "MIT": ["mit_grant", "mit_notice", "mit_as_is"],
    "BSD-3-Clause": ["bsd_redist", "bsd_source", "bsd_binary", "bsd_names"],
    "BSD-2-Clause": ["bsd_redist", "bsd_source", "bsd_binary"],
    "ISC": ["isc_grant"],
    "BSL-1.0": ["boost_grant"],
    "Unlicense": ["unlicense"],
    "Proprietary": ["reserved"],
}

#: A piece ends at a line end, or at a full stop, question or exclamation mark before white space.
CUT = r"[.!?]*[ \t]*[\r\n]+|[.!?]+[ \t]+"
#: Marks of the end of a piece and of a sentence; they are taken out of texts first.
PIECE, SENTENCE = "\x01", "\x02"
#: Ends of pieces that end a sentence too: full stops but those of abbreviations, blank lines, line ends before a list mark.
ENDS = rf"(?<!(?<![A-Za-z])(?i:v|vs|ver|vers|no|inc|ltd|co|corp|art|sec))[.!?]+[ \t]*[\r\n]*{PIECE}|(?:\n\r?\n|\r\r){PIECE}|{PIECE}(?=[^A-Za-z0-9{PIECE}]*{PIECE}|[ \t]*(?:[-+•]|\(?[A-Za-z0-9]{{1,2}}\))[ \t])"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and in whatever lambda ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def words_in(text: Column) -> Column:
    """Lower-case ASCII letters and digits, parted by single spaces, one in front and one behind."""
    return F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")


def sentences_in(text: Column) -> Column:
    """The text's sentences in order: strings of a line end, number, colon and words for each piece, and a last line end."""
    marked = F.regexp_replace(F.translate(text, PIECE + SENTENCE, "\x03\x03"), CUT, "$0" + PIECE)
    marked = F.regexp_replace(marked, ENDS, SENTENCE + PIECE)
    plain = F.regexp_replace(F.translate(marked, UPPER, LOWER), f"[^a-z0-9{PIECE}{SENTENCE}]+", " ")
    pieces = F.transform(F.split(plain, PIECE), lambda p, i: F.concat(F.lit("\n"), i.cast("string"), F.lit(":"), F.regexp_replace(p, f"^ | (?={SENTENCE}?$)", "")))
    return F.transform(F.split(F.array_join(pieces, ""), SENTENCE), lambda s: F.concat(s, F.lit("\n")))


def reference(words: Column) -> Column:
    """What a sentence's or line's words name: ``ref:`` and a licence, or null."""

    def licence(found: Column) -> Column:
        name, version = F.regexp_extract(found, "^([^|]*)", 1), F.regexp_extract(found, "[|](.*)$", 1)
        known: dict[str, list[tuple[str, str]]] = {}
        for pattern, number, of in named():
            known.setdefault(pattern, []).append((number, f"ref:{of}"))
        chain = F.lit(None).cast("string")
        for pattern, versions in reversed(known.items()):
            by_version = F.lit(None).cast("string")
            for number, of in versions:
                by_version = F.when(version == number, of).otherwise(by_version)
            chain = F.when(name.rlike(pattern), by_version).otherwise(chain)
        return chain

    pick = lambda pattern: F.concat(F.regexp_extract(words, pattern, 1), F.lit("|"), F.regexp_extract(words, pattern, 2))
    found = F.when(words.rlike(HINTED) & words.rlike(SAYS) & ~words.rlike(DENIED), F.when(words.rlike(REFERENCE), pick(REFERENCE)).when(words.rlike(GRANTED), pick(GRANTED)))
    return let(found, lambda f: F.when(f.isNotNull(), licence(f)))


def identifiers(text: Column) -> Column:
    """The text's known sentences in order: an array of (place and last of their pieces, number of the sentence they are in, identifier)."""
    known = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(way).alias("words"), F.lit(r"\n[0-9]+:" + way.replace(" ", r"(?: |\n[0-9]+:)") + r"(?=\n)").alias("wrapped")) for name, ways in SENTENCES.items() for way in ways])
    def number(line: Column) -> Column:
        return F.substring_index(line, ":", 1).cast("int")

    def outer(found: Column) -> Column:
        return F.filter(found, lambda x: ~F.exists(found, lambda y: (y["place"] <= x["place"]) & (x["last"] <= y["last"]) & (y["last"] - y["place"] > x["last"] - x["place"])))

    def in_sentence(s: Column, i: Column, here: Column) -> Column:
        found = F.flatten(F.transform(here, lambda k: F.transform(F.regexp_extract_all(s, k["wrapped"], F.lit(0)), lambda m: F.struct(
            number(F.substring_index(F.substring(m, 2, 1 << 30), "\n", 1)).alias("place"), number(F.substring_index(m, "\n", -1)).alias("last"), i.alias("sentence"), k["name"].alias("name"),
        ))))
        return let(F.concat(found, named_in(s, i)), lambda f: F.array_sort(outer(f)))

    def named_in(s: Column, i: Column) -> Column:
        """Licences that the sentence as a whole, without its first line (a heading), or one of its lines names."""
        lines = F.filter(F.split(s, "\n"), lambda line: F.contains(line, F.lit(":")))
        one = lambda line: F.struct(number(line).alias("place"), number(line).alias("last"), F.substring_index(line, ":", -1).alias("words"))
        whole = lambda parts: F.when(F.size(parts) > 1, F.array(F.struct(parts[0]["place"].alias("place"), F.element_at(parts, -1)["last"].alias("last"), F.array_join(F.transform(parts, lambda x: x["words"]), " ").alias("words"))))
        every = let(F.transform(lines, one), lambda parts: F.concat(parts, F.coalesce(whole(parts), F.slice(parts, 1, 0)), F.coalesce(let(F.slice(parts, 2, 1 << 30), whole), F.slice(parts, 1, 0))))
        told = F.transform(every, lambda x: F.struct(x["place"].alias("place"), x["last"].alias("last"), i.alias("sentence"), reference(x["words"]).alias("name")))
        return F.when(s.rlike(HINTED_LINES), F.filter(told, lambda x: x["name"].isNotNull())).otherwise(F.slice(told, 1, 0))

    def gate(words: Column) -> Column:
        return F.struct(F.filter(known, lambda k: F.contains(words, k["words"])).alias("here"), words.rlike(HINTED).alias("hinted"))

    return let(let(words_in(text), gate), lambda g: F.when((F.size(g["here"]) > 0) | g["hinted"], F.flatten(F.transform(sentences_in(text), lambda s, i: in_sentence(s, i, g["here"])))))


def places(ids: Column, name: str) -> Column:
    return F.filter(ids, lambda x: x["name"] == name)


def followed(before: Column, later: Column, gap: int) -> Column:
    """For each of ``before``, the next of ``later`` within the gap; those without one are left out."""

    def step(p: Column) -> Column:
        return F.array_min(F.filter(later, lambda q: (q["place"] > p["last"]) & (q["sentence"] <= p["sentence"] + gap + 1)))

    return F.filter(F.transform(before, step), lambda p: p.isNotNull())


def statements(ids: Column, rule: list[str], gap: int) -> Column:
    """How often the rule's identifiers follow one another in ``ids``, neighbours at most ``gap`` sentences apart."""
    at = places(ids, rule[0])
    for name in rule[1:]:
        at = followed(at, places(ids, name), gap)
    return F.size(at)


def scan(docs: DataFrame, gap: int = GAP) -> DataFrame:
    """doc_id, licence, statements, first_sentence for each licence that a document states."""
    # every known sentence has one of these words (not parted by a line end), so other texts need not be cut
    hint = let(F.lower("text"), lambda low: reduce(Column.__or__, [F.contains(low, F.lit(w)) for w in TELLING]))

    def stated(ids: Column) -> Column:
        found = F.array(*[F.struct(F.lit(licence).alias("licence"), statements(ids, rule, gap).alias("n"), F.array_min(places(ids, rule[0]))["place"].alias("first")) for licence, rule in RULES.items()])
        named = F.transform(F.filter(ids, lambda x: x["name"].startswith("ref:")), lambda x: F.struct(F.substring(x["name"], 5, 100).alias("licence"), F.lit(1).alias("n"), x["place"].alias("first")))
        return let(F.concat(F.filter(found, lambda x: x["n"] > 0), named), by_licence)

    def by_licence(found: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(found, lambda x: x["licence"])), lambda name: F.struct(
            name.alias("licence"),
            F.aggregate(F.filter(found, lambda x: x["licence"] == name), F.lit(0), lambda a, x: a + x["n"]).alias("n"),
            F.array_min(F.transform(F.filter(found, lambda x: x["licence"] == name), lambda x: x["first"])).alias("first"),
        ))

    # one expression, so that no rule of the optimizer makes copies of its parts
    rows = docs.where("text is not null").where(hint).select("doc_id", F.explode(let(identifiers(F.col("text")), lambda ids: F.when(F.size(ids) > 0, stated(ids)))).alias("f"))
    return rows.select("doc_id", F.col("f.licence").alias("licence"), F.col("f.n").cast("long").alias("statements"), F.col("f.first").cast("long").alias("first_sentence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle() -> str:
    """The same by unnesting: known sentences joined by equality, rules of several sentences by self-joins."""
    known = ", ".join(f"('{way}', '{name}')" for name, ways in SENTENCES.items() for way in ways)
    names = ", ".join(f"('{pattern}', '{version}', 'ref:{licence}')" for pattern, version, licence in named())
    parts = []
    for licence, rule in RULES.items():
        # a start counts if each next identifier has a place within the gap after the nearest place of the one before
        sql = f"select row_id, doc_id, place as first, place as at from ids where name = '{rule[0]}'"
        for name in rule[1:]:
            sql = f"select t.row_id, t.doc_id, t.first, min(i.place) as at from ({sql}) t join ids i on i.row_id = t.row_id and i.name = '{name}' and i.place > t.at and i.place <= t.at + {GAP + 1} group by all"
        parts.append(f"select row_id, doc_id, '{licence}' as licence, first from ({sql})")
    parts.append("select row_id, doc_id, substr(name, 5), place from ids where starts_with(name, 'ref:')")
    return rf"""
with known(sentence, name) as (values {known}),
texts as (select row_number() over () as row_id, doc_id, string_split_regex(text, '[.!?]*[ \t]*[\r\n]+|[.!?]+[ \t]+') as parts from documents where text is not null),
sentences as (select row_id, doc_id, unnest(parts) as s, generate_subscripts(parts, 1) - 1 as place from texts),
plain as (select row_id, doc_id, place, trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) as words from sentences),
names(pattern, version, licence) as (values {names}),
naming as (
  select row_id, doc_id, place, regexp_extract(words, '{REFERENCE}', 1) as name, regexp_extract(words, '{REFERENCE}', 2) as version from plain where regexp_matches(words, '{SAYS}') and regexp_matches(words, '{REFERENCE}') and not regexp_matches(words, '{DENIED}')
  union all
  select row_id, doc_id, place, regexp_extract(words, '{GRANTED}', 1), regexp_extract(words, '{GRANTED}', 2) from plain where regexp_matches(words, '{SAYS}') and regexp_matches(words, '{GRANTED}') and not regexp_matches(words, '{REFERENCE}') and not regexp_matches(words, '{DENIED}')),
ids as (
  select row_id, doc_id, place, name from plain join known on words = sentence
  union all select row_id, doc_id, place, licence from naming join names on regexp_matches(name, pattern) and naming.version = names.version),
found as ({" union all ".join(parts)})
select doc_id, licence, count(*) as statements, cast(min(first) as bigint) as first_sentence from found group by row_id, doc_id, licence
"""

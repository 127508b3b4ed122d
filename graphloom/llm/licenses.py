"""Licence recognition by sentence rules, in DataFrame functions only.

A text is cut into sentences; each is normalised and looked up in a table of known licence sentences, which gives an
identifier; notices with parts that vary (a version, a name) are recognised by patterns instead. The identifiers in order
of the text, with a gap wherever other sentences stand between, form a short string. Ordered rules are sequences of
identifiers: each names the licence of every sequence that it matches, whole licence texts first, and what an earlier
rule has taken is gone for the later ones. Licence sentences that no rule takes are reported as such.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
from string import ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_sentences import TEXTS, VARIANTS

#: (identifier, pattern over a normalised sentence): the first that matches holds. Patterns are searched for, in a
#: syntax that Java and RE2 share. Identifiers are capital letters.
SENTENCES: list[tuple[str, str]] = [
    ("SPDX", r"spdx license identifier"),
    ("GPLTHREE", r"licensed under (the )?gnu general public license,? (version|v) ?3"),
    ("GPLTWO", r"licensed under (the )?gnu general public license,? (version|v) ?2"),
    ("LGPL", r"licensed under (the )?gnu lesser general public license"),
    ("AGPL", r"licensed under (the )?gnu affero general public license"),
    ("GPLANY", r"licensed under (the )?gnu general public license"),
    ("APACHETWO", r"licensed under (the )?apache license,? version 2"),
    ("APACHEUSE", r"you may not use this file except in compliance with the license"),
    ("APACHECOPY", r"you may obtain a copy of the license at"),
    ("MIT", r"(released|licensed) under (the )?mit license"),
    ("MITGRANT", r"permission is hereby granted,? free of charge,? to any person obtaining a copy"),
    ("MITNOTICE", r"the above copyright notice and this permission notice shall be included"),
    ("BSD", r"(released|licensed) under (the )?bsd license"),
    ("BSDGRANT", r"redistribution and use in source and binary forms"),
    ("BSDSOURCE", r"redistributions of source code must retain"),
    ("BSDBINARY", r"redistributions in binary form must reproduce"),
    ("BSDNAME", r"neither the name of"),
    ("CCBYNCSA", r"licensed under (a )?(cc by nc sa|creative commons attribution noncommercial sharealike)"),
    ("CCBYNC", r"licensed under (a )?(cc by nc|creative commons attribution noncommercial)"),
    ("CCBYSA", r"licensed under (a )?(cc by sa|creative commons attribution sharealike)"),
    ("CCBY", r"licensed under (a )?(cc by|creative commons attribution)"),
    ("CCZERO", r"cc0|creative commons zero"),
    ("MPL", r"subject to the terms of the mozilla public license"),
    ("ASIS", r"the software is provided as is"),
    ("RIGHTS", r"all rights reserved"),
    ("UNKNOWN", r"\blicen[sc]ed? under\b|\breleased under\b"),
]

#: (licence, sequence of identifiers) in order; "~" stands for at most one gap of other sentences, "?" for what may lack.
RULES: list[tuple[str, str]] = [
    ("BSD-3-Clause", "BSDGRANT~BSDSOURCE~BSDBINARY~BSDNAME"),
    ("BSD-2-Clause", "BSDGRANT~BSDSOURCE~BSDBINARY"),
    ("MIT", "MITGRANT~MITNOTICE~ASIS"),
    ("MIT", "MITGRANT~MITNOTICE"),
    ("Apache-2.0", "APACHETWO~APACHEUSE~APACHECOPY"),
    ("Apache-2.0", "APACHETWO"),
    ("GPL-3.0", "GPLTHREE"),
    ("GPL-2.0", "GPLTWO"),
    ("LGPL", "LGPL"),
    ("AGPL", "AGPL"),
    ("GPL", "GPLANY"),
    ("MIT", "MIT"),
    ("BSD", "BSD"),
    ("CC-BY-NC-SA", "CCBYNCSA"),
    ("CC-BY-NC", "CCBYNC"),
    ("CC-BY-SA", "CCBYSA"),
    ("CC-BY", "CCBY"),
    ("CC0-1.0", "CCZERO"),
    ("MPL", "MPL"),
    ("All-Rights-Reserved", "RIGHTS"),
]

#: A sentence ends at a line's end, or at . ! ? followed by white space.
BREAK = r"\n+|[.!?]+[ \t\r]+"
#: "released under the terms of the", and "SPDX-License-Identifier:", which names a licence by itself.
_UNDER = r"\b(licen[sc]ed|released|distributed|available|published|provided|issued|shared) under (the |a |an )?(terms of (the |a |an )?)?"
_SPDX = r"spdx license identifier "
_GIVEN = rf"({_UNDER}|{_SPDX})"
_TERMS = r"terms (and conditions )?of "
_CC = _GIVEN + r"(creative commons |cc )(licen[sc]e )?(by|attribution)"
_NC, _SA, _ND = r" (nc|non ?commercial)", r" (sa|share ?alike)", r" (nd|no ?deriv[a-z]*)"


def _gnu(name: str, short: str, version: str) -> str:
    """Notices that name a GNU licence, of a version or (with "") of any."""
    after = rf"( as published by the free software foundation)?,? (either )?(version |v ?)?{version}\b" if version else ""
    of = rf"|{_TERMS}version {version} of the gnu {name}general public licen[sc]e" if version else ""
    number = rf" ?v? ?{version}\b" if version else r"( ?v? ?\d|\b)"
    return rf"({_UNDER}|{_TERMS}(the )?)gnu {name}general public licen[sc]e{after}{of}|{_GIVEN}(gnu )?{short}{number}"


#: More phrasings, tried before SENTENCES: real headers, SPDX identifiers, "released under" forms.
MORE_SENTENCES: list[tuple[str, str]] = [
    ("LGPL", _gnu("(lesser |library )", "lgpl", "")),
    ("AGPL", _gnu("affero ", "agpl", "")),
    ("GPLTHREE", _gnu("", "gpl", "3")),
    ("GPLTWO", _gnu("", "gpl", "2")),
    ("GPLANY", _gnu("", "gpl", "")),
    ("APACHETWO", _GIVEN + r"apache (software )?(licen[sc]e,? )?(version |v ?)?2"),
    ("MIT", _GIVEN + r"(mit|expat)\b"),
    ("BSDTHREE", _GIVEN + r"(bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd)"),
    ("BSDTWO", _GIVEN + r"(bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)"),
    ("BSD", _GIVEN + r"bsd\b"),
    ("ISC", _GIVEN + r"isc\b"),
    ("MPL", rf"{_GIVEN}(mozilla public licen[sc]e|mpl)|{_TERMS}the mozilla public licen[sc]e"),
    ("CCBYNCSA", _CC + _NC + _SA),
    ("CCBYNCND", _CC + _NC + _ND),
    ("CCBYNC", _CC + _NC),
    ("CCBYSA", _CC + _SA),
    ("CCBYND", _CC + _ND),
    ("CCBY", _CC),
    ("CCZERO", _GIVEN + r"(cc0|cc zero|creative commons zero)"),
    ("ZLIBGRANT", r"permission is granted to anyone to use this software for any purpose, including commercial applications"),
]
MORE_RULES: list[tuple[str, str]] = [
    ("BSD-3-Clause", "BSDTHREE"), ("BSD-2-Clause", "BSDTWO"), ("ISC", "ISC"), ("CC-BY-NC-ND", "CCBYNCND"), ("CC-BY-ND", "CCBYND"),
    ("Zlib", "ZLIBGRANT"),
]
#: A word of every pattern and of every sentence of the table, in plain or normalised text: what hasn't any isn't looked at.
ANY_HINT = (
    r"(?i)licen[sc]|redistribut|permission|copyright|rights\W+reserved|cc0|creative\W+commons|neither\W+the\W+name|provided\W+as"
    r"|(released|distributed|available|published|provided|issued|shared)\W+under|general\W+public|mozilla"
    r"|warrant|liable|public\W+domain|anyone\W+is\W+free|\bmpl\b"
)

#: One of these is in whatever ANY_HINT finds, in lower case; plain search is several times as fast.
WORDS = (
    "licen redistribut permission copyright reserved cc0 commons neither released distributed available published provided "
    "issued shared general mozilla warrant liable domain anyone mpl"
).split()


def plain(sentence: str) -> str:
    """A sentence of the table as ``normalise`` gives it."""
    return re.sub(r"[^a-z0-9,]+", " ", sentence.lower()).strip()


def _table() -> tuple[dict[str, str], list[tuple[str, str]]]:
    """(normalised sentence -> identifier, rules of whole texts, the longest first).

    A sentence that a pattern recognises, too, has the pattern's identifier, so that shorter rules know it as well.
    """
    known: dict[str, str] = {}
    rules = []
    for k, (licence, sentences) in enumerate(TEXTS):
        for n, sentence in enumerate(map(plain, sentences)):
            own = f"TEXT{ascii_uppercase[k // 26]}{ascii_uppercase[k % 26]}{ascii_uppercase[n]}"
            match = next((i for i, p in MORE_SENTENCES + SENTENCES if i not in ("ASIS", "UNKNOWN") and re.search(p, sentence)), own)
            known.setdefault(sentence, match)
        if len(sentences) > 1:
            rules.append((licence, "~".join(known[plain(x)] for x in sentences)))
    known |= {plain(other): known[plain(one)] for one, other in VARIANTS}
    # Sentences that only the table knows, but for a text's first, may be left out: they don't tell licences apart.
    short = [(licence, seq.split("~")) for licence, seq in rules]
    rules = []
    for licence, seq in short:
        needed = max([0, *[k for k, i in enumerate(seq) if not i.startswith("TEXT")]]) + 1
        parts = [i if k == 0 or not i.startswith("TEXT") else f"{i}?" for k, i in enumerate(seq)]
        rules.append((licence, "~".join([*parts[:needed], "ASIS?", *parts[needed:]])))
    rules += [(licence, known[plain(x[0])]) for licence, x in TEXTS if len(x) == 1]
    return known, sorted(rules, key=lambda r: (-r[1].replace("?", "").count("~"), -len(r[1])))


KNOWN, TEXT_RULES = _table()
#: The margin of a line in a comment.
_MARGIN = r"[ \t\r]*\n[ \t]*(?:(?:[#*;%]+|//+|--+)[ \t]+)?"
#: A break within a sentence: the next line goes on in lower case, or the last ends in a word that can't end a sentence.
WRAP = (
    rf"(?<![.!?:;\n \t\r]){_MARGIN}(?=[\p{{Ll}}(])"
    # a line of full length that doesn't end a sentence, as in texts in capitals
    rf"|(?<=[^\n]{{60}})(?<![.!?:;\n \t\r]){_MARGIN}(?=\S)"
    rf"|(?<=\b(?:the|a|of|under|by|GNU|General|Lesser|Affero|Public|Creative|Commons|Apache|Mozilla|Version|version)){_MARGIN}(?=[\p{{L}}\p{{N}}])"
)
#: Between the licences of one SPDX expression.
SPDX_NEXT = r"(?i)[ \t]+(?:or|and)[ \t]+(?<=spdx-license-identifier:[^\n]{0,300})"


def unwrapped(text: Column) -> Column:
    """Sentences that go on in the next line are joined; each licence of an SPDX expression has a line of its own."""
    split = F.regexp_replace(text, SPDX_NEXT, "\nSPDX-License-Identifier: ")
    return F.regexp_replace(F.when(text.rlike(r"(?i)spdx-license"), split).otherwise(text), WRAP, " ")


def normalise(sentence: Column) -> Column:
    """Lower case; everything but letters, digits and commas is one space."""
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N},]+", " "))


def identify(sentence: Column) -> Column:
    """The identifier of a normalised sentence, or null: by the table, else by the patterns."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(MORE_SENTENCES + SENTENCES):
        out = F.when(sentence.rlike(pattern), F.lit(name)).otherwise(out)
    table = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    return F.when(sentence.rlike(ANY_HINT), F.coalesce(F.try_element_at(table, sentence), out))


def sequence(text: Column) -> Column:
    """The identifiers of the text's licence sentences, "|A|-|B|", or "|" for none."""
    # A mark after each break keeps sentences that end alike apart; neighbours with nothing between are adjacent.
    found = F.transform(F.split(unwrapped(text), BREAK), lambda s: F.coalesce(identify(normalise(s)), F.lit("-")))
    joined = F.concat(F.lit("|"), F.array_join(found, "|"), F.lit("|"))
    joined = F.regexp_replace(joined, r"(-\|)+", "-|")
    return F.regexp_replace(F.regexp_replace(joined, r"^\|-\|", "|"), r"\|-\|$", "|")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, sentence_ids ("|A|-|B|"), licenses (sorted, comma-separated), n_matches, unmatched.

    Null and empty texts, and texts without a licence sentence, have no licence ("" and 0). ``unmatched`` counts
    licence sentences that no rule takes. Rows that repeat give rows that repeat; other columns may have any names; an
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("low", F.lower("text"))
    # The whole text is searched, first for words, then for hints; only texts with any hint are cut into sentences.
    word = reduce(or_, [F.contains("low", F.lit(w)) for w in WORDS])
    ids = F.when(word, F.when(F.col("text").rlike(ANY_HINT), sequence(F.col("text")))).otherwise(F.lit("|"))
    rows = rows.select("doc_id", F.coalesce(ids, F.lit("|")).alias("sentence_ids"))
    left: Column = F.regexp_replace("sentence_ids", r"\|", "||")
    rules = TEXT_RULES + RULES + MORE_RULES
    for k, (_, seq) in enumerate(rules):
        left = F.regexp_replace(left, doubled(seq), f"<{k:02d}>")
    rows = rows.withColumn("marks", left)
    marks = F.regexp_extract_all("marks", F.lit(r"<(\d\d)>"), 1)
    names = F.array(*[F.lit(n) for n, _ in rules])
    named = F.transform(marks, lambda m: F.element_at(names, m.cast("int") + 1))
    return rows.select(
        "doc_id",
        "sentence_ids",
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("licenses"),
        F.size(marks).cast("long").alias("n_matches"),
        F.regexp_count("marks", F.lit(r"\|[A-Z]+\|")).cast("long").alias("unmatched"),
    )


def doubled(seq: str) -> str:
    """The rule's pattern where every bar is doubled, so that matches next to each other don't share one."""
    first, *rest = seq.split("~")
    gap = r"\|\|(-\|\|)?"
    return r"\|" + first + "".join(f"({gap}{i[:-1]})?" if i.endswith("?") else gap + i for i in rest) + r"\|"

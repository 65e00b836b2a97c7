"""Licence scans by sentence rules (DataFrame functions only).

A text is cut into sentences, each is normalised (lower case, letters and digits, single spaces; copyright
notices and licence tags become their own tokens) and mapped to the identifier of a known licence sentence. Rules are
ordered sequences of identifiers, tried from the most specific to the most general; sentences that a rule has used are
taken out, so a general rule does not report them again.

Sentences are read twice: once with line breaks as spaces (wrapped licence texts), once line by line
(notices without a full stop before them). A licence that either reading gives is reported.

All work is inside a row: nothing is shuffled, and only texts with a licence word are cut. Null and empty
texts have no licence. Null ids and repeated rows give one result row each. An empty table gives an empty result.
Extra columns are passed over.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import let

# Every known sentence, in every opening, holds one of these (tests/llm/test_licenses.py checks it), so a text without them has
# none. Each is part of one word, or has what may stand between words: line breaks and marks.
TRIGGERS = r"(?i)licen[sc]e|copyright|spdx|permission|redistribut|warrant|domain|reserved|software"
TRIGGERS += r"|(?:released|distributed|provided|published|offered|available)[\W_]+under"

# Known licence sentences, as they read after normalising.
SENTENCES: dict[str, str] = {
    "mit_title": "the mit license",
    "mit_title_short": "mit license",
    "mit_grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
        "persons to whom the software is furnished to do so subject to the following conditions"
    ),
    "mit_notice": (
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software"
    ),
    "as_is": (
        "the software is provided as is without warranty of any kind express or implied including but not limited to the "
        "warranties of merchantability fitness for a particular purpose and noninfringement"
    ),
    "isc_grant": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "apache_licensed_the": "licensed under apache license 2 0 the",
    "apache_title": "apache license version 2 0",
    "apache_use": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache_as_is": (
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on "
        "an as is basis without warranties or conditions of any kind either express or implied"
    ),
    "bsd_grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met"
    ),
    "bsd_source": (
        "redistributions of source code must retain the above copyright notice this list of conditions and the following "
        "disclaimer"
    ),
    "bsd_binary": (
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
        "disclaimer in the documentation and or other materials provided with the distribution"
    ),
    "gpl_free": "this program is free software",
    "mpl2_subject": (
        "this source code form is subject to the terms of the mozilla public license v 2 0"
    ),
    "unlicense": "this is free and unencumbered software released into the public domain",
    "cc0": "this work is dedicated to the public domain under cc0 1 0",
    "all_rights": "all rights reserved",
}

# A sentence that opens in one of these ways reads as `licensed under` and the bare name of the licence: without an article, the
# word version, `or later` and the like, and a last `license`.
OPENING = (
    r"^(?:(?:this|the) (?:\p{L}+ ){1,3}(?:is|are) )?(?:licen[sc]ed|released|distributed|provided|published|offered|made available|available) "
    r"under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?"
)
BARE = (
    (OPENING, "licensed under "),
    # clauses that only say where the licence stands, and choices without another name
    (r" (?:please )?(?:see|refer to|as (?:found|stated|described|included) in|which can be found|a copy of which) .*$", ""),
    (r" at your (?:option|choice)$", ""),
    (r"(?: only| or later| or (?:at your option )?any later version)$", ""),
    (r"(?<= )(?:version |v ?)(?=[0-9])", ""),
    (r"(?: international)?(?: public)? licen[sc]e$", ""),
    (r"( 4 0) international$", "$1"),
)
# Names in one grant, and licences in one SPDX expression, stand between these; `or later` belongs to its name.
EITHER = r"^licensed under (?:either|any|one|both)(?: of)?(?: the following)? (?:the )?"
BETWEEN = r" (?:and or|or|and)(?: under)?(?: the| an?)? (?!later\b|any later\b|at your\b)"
SPDX_TAG = "spdx license identifier "
SPDX_REST = r" with .*$"  # exceptions
SPDX_LAST = r"(?: only| or later)$"
# The GNU notices go on behind a colon.
FREE = r"^this \p{L}+ is free software (?=you can redistribute it )"

# Bare names of the licences.
GNU = {
    "GPL": ("gnu general public license", ("2", "3")), "LGPL": ("gnu lesser general public license", ("2 1", "3")),
    "AGPL": ("gnu affero general public license", ("3",)),
}
CC = {
    "BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives",
    "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives",
}


def _license_id(short: str, version: str) -> str:
    return f"{short}-{version.replace(' ', '.')}" if " " in version else f"{short}-{version}.0"


def _gnu_names(short: str, name: str, version: str) -> tuple[str, ...]:
    numbers = (version,) if " " in version else (version, f"{version} 0")
    short = short.lower()
    return tuple(f"{n}{x}" for x in numbers for n in (f"{name} ", f"{name} {short} ", f"gnu {short} ", f"gnu {short}v", f"{short} ", f"{short}v"))


NAMES: dict[str, tuple[str, ...]] = {
    "MIT": ("mit",), "ISC": ("isc",), "Unlicense": ("unlicense",), "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal"),
    "Apache-2.0": ("apache license 2 0", "apache 2 0", "apache license 2", "apache 2", "apache software license 2 0"),
    "BSL-1.0": ("boost software license 1 0", "boost software license", "boost 1 0"), "Zlib": ("zlib", "zlib libpng", "zlib png"),
    "EPL-1.0": ("eclipse public license 1 0", "epl 1 0"), "EPL-2.0": ("eclipse public license 2 0", "epl 2 0"),
    "Artistic-2.0": ("artistic license 2 0", "artistic 2 0"), "WTFPL": ("wtfpl",), "OFL-1.1": ("sil open font license 1 1", "open font license 1 1", "ofl 1 1"),
    "BSD": ("bsd",), "BSD-2-Clause": ("bsd 2 clause", "2 clause bsd"), "BSD-3-Clause": ("bsd 3 clause", "3 clause bsd"),
    **{_license_id(k, v): _gnu_names(k, name, v) for k, (name, versions) in GNU.items() for v in versions},
    "MPL-2.0": ("mozilla public license 2 0", "mpl 2 0"),
    **{
        f"CC-{k}-4.0": (f"cc {(x := k.lower().replace('-', ' '))} 4 0", f"creative commons {x} 4 0", f"creative commons {v} 4 0")
        for k, v in CC.items()
    },
}
# Licences of SPDX tags.
SPDX = (
    "0BSD", "AFL-3.0", "AGPL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause",
    "BSD-4-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0",
    "CC-BY-SA-3.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0",
    "LGPL-2.1", "LGPL-3.0", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "OFL-1.1", "OpenSSL", "PHP-3.01", "PostgreSQL",
    "Python-2.0", "Ruby", "Unlicense", "Vim", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1",
)
GRANTS = {f"{licence}_{n}": licence for licence, names in NAMES.items() for n in range(len(names))}
NOTICES = {f"notice_{k}_{v}".replace(" ", "_"): _license_id(k, v) for k, (_, versions) in GNU.items() for v in versions}

SENTENCES |= {f"{licence}_{n}": f"licensed under {x}" for licence, names in NAMES.items() for n, x in enumerate(names)}
for _k, (_name, _versions) in GNU.items():
    _terms = f"you can redistribute it and or modify it under the terms of the {_name} as published by the free software foundation"
    SENTENCES[f"terms_{_k}"] = _terms  # semicolons end sentences, commas and colons do not
    for _v in _versions:
        _either = f"either version {_v} of the license or at your option any later version"
        SENTENCES[f"either_{_v}".replace(" ", "_")] = _either
        SENTENCES[f"notice_{_k}_{_v}".replace(" ", "_")] = f"{_terms} {_either}"

# Sentences with a variable part: the pattern of the normalised sentence and the sentence's identifier.
PATTERNS: dict[str, str] = {
    "bsd_endorse": (
        "neither the names? of .{1,160} nor the names of (its|the|their) contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission"
    ),
    "copyright": r"(\p{L}+ )?copyright( c)? [0-9]{4}( [0-9]{4})*( .*)?",
}


@dataclass(frozen=True)
class Rule:
    """A licence and the sentence identifiers that, one after another, mean it. A rule that was added later and is more specific than
    others is tried `first` and keeps its number at the end."""

    license: str
    sentences: tuple[str, ...]
    first: bool = False


# Rules in the order in which they are tried, those marked `first` before all others.
RULES: tuple[Rule, ...] = (
    Rule("Apache-2.0", ("apache_licensed_the", "apache_use", "apache_copy", "apache_as_is")),
    Rule("Apache-2.0", ("apache_licensed_the", "apache_use")),
    Rule("MIT", ("mit_grant", "mit_notice", "as_is")),
    Rule("MIT", ("mit_grant", "mit_notice")),
    Rule("BSD", ("bsd_grant", "bsd_source", "bsd_binary")),
    Rule("BSD", ("bsd_grant", "bsd_source")),
    *[Rule(_license_id(k, v), (f"terms_{k}", f"either_{v}".replace(" ", "_"))) for k, (_, versions) in GNU.items() for v in versions],
    Rule("ISC", ("isc_grant",)),
    Rule("MIT", ("mit_grant",)),
    Rule("MIT", ("mit_title",)),
    Rule("MIT", ("mit_title_short",)),
    Rule("Apache-2.0", ("apache_licensed_the",)),
    Rule("Apache-2.0", ("apache_title",)),
    Rule("BSD", ("bsd_grant",)),
    Rule("MPL-2.0", ("mpl2_subject",)),
    Rule("Unlicense", ("unlicense",)),
    Rule("CC0-1.0", ("cc0",)),
    *[Rule(licence, (name,)) for name, licence in (GRANTS | NOTICES).items()],
    *[Rule(licence, (f"spdx_{licence}",)) for licence in SPDX],
    Rule("Proprietary", ("copyright", "all_rights")),
    Rule("Proprietary", ("all_rights",)),
    Rule("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"), first=True),
)

# A full stop, question or exclamation mark or semicolon ends a sentence before white space, a colon at the end of a line;
# so does a line without letters and digits. The full stop of `v. 2.0` ends none, and the number of a clause is no sentence.
STOP = r"(?!(?<=\b[vV])\.\s+[0-9])[.!?;]+\s+"
WRAPPED_END = STOP + r"|:\s*\n|\n(?:[^\p{L}\p{N}\n]*\n)+"
LINE_END = STOP + r"|\n"


def identifiers(text: Column, end: str, sentences: dict[str, str] = SENTENCES, patterns: dict[str, str] = PATTERNS) -> Column:
    """Array of the sentences' identifiers in order; `-` stands for an unknown sentence."""
    known = F.create_map(*[F.lit(x) for name, value in sentences.items() for x in (value, name)])
    tags = F.create_map(*[F.lit(x) for licence in SPDX for x in (licence.lower().replace("-", " ").replace(".", " "), f"spdx_{licence}")])

    def plain(s: Column) -> Column:
        return F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " "))

    def shortened(s: Column, rules: tuple[tuple[str, str], ...]) -> Column:
        for pattern, by in rules:
            s = F.regexp_replace(s, F.lit(pattern), F.lit(by))
        return s

    def bare(s: Column) -> Column:
        return F.when(opened(s), shortened(s, BARE)).when(
            F.contains(s, F.lit("free software you")), F.regexp_replace(s, FREE, "")
        ).otherwise(s)

    def opened(s: Column) -> Column:
        return F.contains(s, F.lit(" under ")) & F.regexp_like(s, F.lit(OPENING))

    def looked_up(s: Column) -> Column:
        found = F.try_element_at(known, bare(s))
        for name, pattern in patterns.items():
            found = F.coalesce(found, F.when(F.regexp_like(s, F.lit(f"^{pattern}$")), F.lit(name)))
        return found

    def several(s: Column) -> Column:
        """Identifiers of the names that one grant gives the choice of."""
        grant = shortened(s, (*BARE[:3], (EITHER, "licensed under ")))
        names = F.split(F.regexp_replace(grant, "^licensed under ", ""), BETWEEN)
        return F.transform(names, lambda n: F.try_element_at(known, shortened(F.concat(F.lit("licensed under "), n), BARE)))

    def tagged(s: Column) -> Column:
        expression = F.regexp_replace(F.substring(s, len(SPDX_TAG) + 1, 10_000), SPDX_REST, "")
        parts = F.split(expression, BETWEEN)
        return F.transform(parts, lambda p: F.try_element_at(tags, F.regexp_replace(F.trim(p), SPDX_LAST, "")))

    def named(s: Column) -> Column:
        one = F.array(looked_up(s))
        ids = F.when(F.startswith(s, F.lit(SPDX_TAG)), tagged(s)).when(
            opened(s) & F.regexp_like(s, F.lit(BETWEEN)) & looked_up(s).isNull(), several(s)
        ).otherwise(one)
        return let(F.filter(ids, lambda x: x.isNotNull()), lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(F.lit("-"))))

    cut = F.filter(F.transform(F.split(text, end), plain), lambda s: (s != "") & ~F.regexp_like(s, F.lit("^[0-9]{1,2}$")))
    return F.flatten(F.transform(cut, named))


def apply_rules(ids: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Array of the numbers of all rules that match, in rule order, from an array of identifiers."""
    keyed = F.array(*[
        F.struct(F.lit(n).alias("n"), F.lit(" " + "  ".join(r.sentences) + " ").alias("key"))
        for n, r in sorted(enumerate(rules), key=lambda x: not x[1].first)
    ])
    start = F.struct(
        F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("rest"), F.array().cast("array<int>").alias("found")
    )

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["rest"], rule["key"])
        return F.struct(
            F.when(hit, F.replace(acc["rest"], rule["key"], F.lit(" + "))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit, F.array_append(acc["found"], rule["n"])).otherwise(acc["found"]).alias("found"),
        )

    return F.aggregate(keyed, start, step, lambda acc: acc["found"])


def scan(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of `docs`: doc_id, licenses (sorted, comma-joined), rules (numbers of the matched rules), sentences (how many
    known ones, in the reading that has more) and status: `none`, `known`, or `unknown` for known sentences without a rule."""
    own = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    seen = own.select("doc_id", F.when(F.regexp_like("_t", F.lit(TRIGGERS)), F.col("_t")).alias("_t"))
    none = F.array().cast("array<string>")
    read = seen.select(
        "doc_id", F.coalesce(identifiers(F.col("_t"), WRAPPED_END), none).alias("wrapped"),
        F.coalesce(identifiers(F.col("_t"), LINE_END), none).alias("lines"),
    )

    def known(c: str) -> Column:
        return F.size(F.array_remove(c, "-"))

    matched = read.select(
        "doc_id", F.greatest(known("wrapped"), known("lines")).cast("long").alias("sentences"),
        F.when(known("wrapped") > 0, apply_rules(F.col("wrapped"), rules)).otherwise(F.array().cast("array<int>")).alias("a"),
        F.when(known("lines") > 0, apply_rules(F.col("lines"), rules)).otherwise(F.array().cast("array<int>")).alias("b"),
    )
    licence = F.array(*[F.lit(r.license) for r in rules])
    both = matched.select("doc_id", "sentences", F.sort_array(F.array_union("a", "b")).alias("found"))
    return both.select(
        "doc_id",
        F.array_join(F.sort_array(F.array_distinct(F.transform("found", lambda n: F.get(licence, n)))), ",").alias("licenses"),
        F.array_join(F.transform("found", lambda n: n.cast("string")), ",").alias("rules"), "sentences",
        F.when(F.size("found") > 0, "known").when(F.col("sentences") > 0, "unknown").otherwise("none").alias("status"),
    )

"""License scan by ordered signature rules.

A text is reduced to its words (A-Z lower-cased, punctuation gone), joined by single
spaces, and hundreds of regular expressions are tried on it: signatures written by hand, and
names with their versions. A rule runs only if the text has all of the rule's keywords. Rules
are listed by the keyword that fewest of them share, so a text meets those only whose
rarest keyword it has; most texts run no rule at all. Detections overlap ("apache license version 2 0" lies in the SPDX
line around it), so they are taken in the order of their rule's priority and a detection
inside an accepted one is dropped. Base phrases are counted before that and always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame

from martwright.llm.shared import alnum_words

# Phrases that every scan counts, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# License families, their versions as words, and the names they go by.
VERSIONED = {
    "apache": (("1 0", "1 1", "2 0"), ("apache license", "apache software license")),
    "gpl": (("1", "2", "3"), ("gnu general public license", "general public license", "gnu gpl", "gplv", "gpl")),
    "lgpl": (("2", "2 1", "3"), ("gnu lesser general public license", "gnu library general public license", "lgplv", "lgpl")),
    "agpl": (("1", "3"), ("gnu affero general public license", "affero general public license", "agplv", "agpl")),
    "fdl": (("1 1", "1 2", "1 3"), ("gnu free documentation license", "gfdl")),
    "mpl": (("1 0", "1 1", "2 0"), ("mozilla public license", "mpl")),
    "epl": (("1 0", "2 0"), ("eclipse public license", "epl")),
    "eupl": (("1 0", "1 1", "1 2"), ("european union public licence", "european union public license", "eupl")),
    "cddl": (("1 0", "1 1"), ("common development and distribution license", "cddl")),
    "cpl": (("1 0",), ("common public license",)),
    "osl": (("1 0", "2 0", "2 1", "3 0"), ("open software license", "osl")),
    "afl": (("2 0", "2 1", "3 0"), ("academic free license",)),
    "artistic": (("1 0", "2 0"), ("artistic license",)),
    "boost": (("1 0",), ("boost software license", "bsl")),
    "ofl": (("1 0", "1 1"), ("sil open font license", "open font license", "ofl")),
    "odbl": (("1 0",), ("open database license", "odbl")),
    "cecill": (("1 0", "2 0", "2 1"), ("cecill",)),
    "zpl": (("1 1", "2 0", "2 1"), ("zope public license", "zpl")),
    "php": (("3 0", "3 01"), ("php license",)),
    "python": (("2", "2 0"), ("python software foundation license", "psf license")),
    "lppl": (("1 2", "1 3"), ("latex project public license", "lppl")),
}
# Creative Commons elements and versions.
CC_ELEMENTS = {"": "attribution", "nc": "noncommercial", "nd": "noderivatives", "sa": "sharealike", "nc sa": "noncommercial sharealike", "nc nd": "noncommercial noderivatives"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
# Identifiers of licenses in SPDX tags that the tables above do not give, as words.
SPDX = {
    "mit": "mit", "mit 0": "mit-0", "isc": "isc", "zlib": "zlib", "0bsd": "0bsd", "unlicense": "unlicense", "wtfpl": "wtfpl",
    "ncsa": "ncsa", "x11": "x11", "postgresql": "postgresql", "json": "json", "vim": "vim", "ruby": "ruby", "openssl": "openssl",
    "curl": "curl", "icu": "icu", "ftl": "ftl", "libpng": "libpng", "w3c": "w3c", "beerware": "beerware", "naist 2003": "naist-2003",
    "bsd 1 clause": "bsd-1-clause", "bsd 2 clause": "bsd-2-clause", "bsd 2 clause patent": "bsd-2-clause-patent",
    "bsd 3 clause": "bsd-3-clause", "bsd 3 clause clear": "bsd-3-clause-clear", "bsd 4 clause": "bsd-4-clause",
    "cc0 1 0": "cc0", "upl 1 0": "upl-1.0", "blueoak 1 0 0": "blueoak-1.0.0", "mulanpsl 2 0": "mulanpsl-2.0", "ms pl": "ms-pl",
    "ms rl": "ms-rl", "psf 2 0": "python-2.0", "unicode dfs 2016": "unicode", "unicode 3 0": "unicode", "bsl 1 1": "busl-1.1",
    "busl 1 1": "busl-1.1", "sspl 1 0": "sspl-1.0", "elastic 2 0": "elastic-2.0", "polyform noncommercial 1 0 0": "polyform-noncommercial-1.0.0",
    "odc by 1 0": "odc-by-1.0", "pddl 1 0": "pddl-1.0", "etalab 2 0": "etalab-2.0", "ogl uk 3 0": "ogl-uk-3.0", "rpl 1 5": "rpl-1.5",
    "apl 1 0": "apl-1.0", "cpal 1 0": "cpal-1.0", "ipl 1 0": "ipl-1.0", "spl 1 0": "spl-1.0", "qpl 1 0": "qpl-1.0", "ecl 2 0": "ecl-2.0",
    "ofl 1 1 rfn": "ofl-1.1-rfn", "linux man pages copyleft": "linux-man-pages", "hpnd": "hpnd", "tcl": "tcl", "xnet": "xnet",
}
# Addresses at which licenses stand, as the words of the address.
ADDRESSES = {
    "apache org licenses license 1 1": "apache-1.1", "apache org licenses license 2 0": "apache-2.0",
    "opensource org licenses? mit": "mit", "opensource org licenses? isc": "isc", "opensource org licenses? zlib": "zlib",
    "opensource org licenses? 0bsd": "0bsd", "opensource org licenses? unlicense": "unlicense", "opensource org licenses? ncsa": "ncsa",
    "opensource org licenses? postgresql": "postgresql", "opensource org licenses? apache 2 0": "apache-2.0",
    "opensource org licenses? bsd 2 clause": "bsd-2-clause", "opensource org licenses? bsd 3 clause": "bsd-3-clause",
    "opensource org licenses? bsd license(?: php)?": "bsd", "opensource org licenses? mit license(?: php)?": "mit",
    "opensource org licenses? gpl 2 0": "gpl-2", "opensource org licenses? gpl 3 0": "gpl-3", "opensource org licenses? gpl license": "gpl",
    "opensource org licenses? lgpl 2 1": "lgpl-2.1", "opensource org licenses? lgpl 3 0": "lgpl-3", "opensource org licenses? agpl 3 0": "agpl-3",
    "opensource org licenses? mpl 2 0": "mpl-2.0", "opensource org licenses? epl 2 0": "epl-2.0", "opensource org licenses? artistic 2 0": "artistic-2.0",
    "opensource org licenses? afl 3 0": "afl-3.0", "opensource org licenses? osl 3 0": "osl-3.0", "opensource org licenses? cddl 1 0": "cddl-1.0",
    "gnu org licenses gpl(?: [a-z]+)?": "gpl", "gnu org licenses gpl 3 0": "gpl-3", "gnu org licenses old licenses gpl 2 0": "gpl-2",
    "gnu org licenses lgpl(?: [a-z]+)?": "lgpl", "gnu org licenses lgpl 3 0": "lgpl-3", "gnu org licenses old licenses lgpl 2 1": "lgpl-2.1",
    "gnu org licenses agpl(?: [a-z]+)?": "agpl", "gnu org licenses agpl 3 0": "agpl-3", "gnu org licenses fdl(?: [a-z]+)?": "fdl",
    "gnu org licenses old licenses fdl 1 2": "fdl-1.2", "gnu org copyleft gpl(?: [a-z]+)?": "gpl", "gnu org copyleft lesser(?: [a-z]+)?": "lgpl",
    "mozilla org mpl(?: [a-z]+)?": "mpl", "mozilla org mpl 2 0": "mpl-2.0", "mozilla org mpl 1 1": "mpl-1.1", "mozilla org en us mpl 2 0": "mpl-2.0",
    "eclipse org legal epl v10(?: html)?": "epl-1.0", "eclipse org legal epl 2 0": "epl-2.0", "eclipse org legal epl v20(?: html)?": "epl-2.0",
    "boost org license 1 0(?: txt)?": "boost-1.0", "scripts sil org ofl": "ofl", "openfontlicense org": "ofl", "unlicense org": "unlicense",
    "wtfpl net": "wtfpl", "sam zoy org wtfpl": "wtfpl", "creativecommons org publicdomain zero 1 0": "cc0",
    "creativecommons org publicdomain mark 1 0": "public-domain", "creativecommons org licenses publicdomain": "public-domain",
    "opendatacommons org licenses odbl": "odbl", "opendatacommons org licenses by": "odc-by", "opendatacommons org licenses pddl": "pddl",
    "nationalarchives gov uk doc open government licence": "ogl-uk", "php net license 3 01(?: txt)?": "php-3.01", "php net license 3 0(?: txt)?": "php-3.0",
    "python org psf license": "python", "docs python org 3 license": "python", "openssl org source license": "openssl", "curl se docs copyright": "curl",
    "perlfoundation org artistic license 2 0": "artistic-2.0", "cecill info licences": "cecill", "latex project org lppl": "lppl",
    "joinup ec europa eu collection eupl": "eupl", "w3 org consortium legal": "w3c", "unicode org copyright": "unicode",
    "mongodb com licensing server side public license": "sspl", "elastic co licensing elastic license": "elastic",
    "polyformproject org licenses noncommercial 1 0 0": "polyform-noncommercial-1.0.0", "mariadb com bsl11": "busl-1.1",
}
_PUBLISHED = "as published by the free software foundation"
_LATER = "of the license or at your option any later version"
# Notices; `w` stands for up to six words.
NOTICES = {
    "gpl-1-or-later": (f"gnu general public license {_PUBLISHED} either version 1 {_LATER}",),
    "gpl-2-or-later": (
        f"gnu general public license {_PUBLISHED} either version 2 {_LATER}",
        f"gnu general public license version 2 {_PUBLISHED} or at your option any later version",
        "gpl version 2 or at your option any later version",
    ),
    "gpl-3-or-later": (
        f"gnu general public license {_PUBLISHED} either version 3 {_LATER}",
        f"gnu general public license version 3 {_PUBLISHED} or at your option any later version",
        "gpl version 3 or at your option any later version",
    ),
    "gpl-2-only": (
        f"gnu general public license version 2 {_PUBLISHED}",
        f"gnu general public license {_PUBLISHED} version 2 of the license",
        f"gnu general public license version 2 only {_PUBLISHED}",
    ),
    "gpl-3-only": (f"gnu general public license version 3 {_PUBLISHED}", f"gnu general public license {_PUBLISHED} version 3 of the license"),
    "lgpl-2-or-later": (f"gnu (?:library|lesser) general public license {_PUBLISHED} either version 2 {_LATER}",),
    "lgpl-2.1-or-later": (f"gnu lesser general public license {_PUBLISHED} either version 2 1 {_LATER}",),
    "lgpl-3-or-later": (f"gnu lesser general public license {_PUBLISHED} either version 3 {_LATER}",),
    "lgpl-2.1-only": (f"gnu lesser general public license version 2 1 {_PUBLISHED}", f"gnu lesser general public license {_PUBLISHED} version 2 1 of the license"),
    "agpl-3-or-later": (f"gnu affero general public license {_PUBLISHED} either version 3 {_LATER}",),
    "agpl-3-only": (f"gnu affero general public license version 3 {_PUBLISHED}", f"gnu affero general public license {_PUBLISHED} version 3 of the license"),
    "gpl": (
        "you should have received a copy of the gnu general public license",
        "this program is distributed in the hope that it will be useful but without any warranty",
        "everyone is permitted to copy and distribute verbatim copies of this license document",
    ),
    "lgpl": ("you should have received a copy of the gnu (?:lesser|library) general public license",),
    "agpl": ("you should have received a copy of the gnu affero general public license",),
    "fdl": ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license",),
    "gpl-classpath": ("as a special exception the copyright holders of this library give you permission to link this library",),
    "gpl-font": ("as a special exception if you create a document which uses this font",),
    "gcc-exception": ("gcc runtime library exception",),
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license",
        "licensed to the apache software foundation asf under one or more contributor license agreements",
    ),
    "apache-1.1": ("this product includes software developed by the apache software foundation",),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file"),
    "mpl-1.1": ("the contents of this file are subject to the mozilla public license version 1 1",),
    "epl-1.0": ("made available under the terms of the eclipse public license v1 0",),
    "epl-2.0": ("made available under the terms of the eclipse public license v? ?2 0",),
    "boost-1.0": ("distributed under the boost software license version 1 0", "permission is hereby granted free of charge to any person or organization obtaining a copy"),
    "ofl-1.1": ("this font software is licensed under the sil open font license version 1 1",),
    "artistic": ("under the same terms as perl itself", "the intent of this document is to state the conditions under which a package may be copied"),
    "mit": (
        "mit license", "expat license", "licensed under the mit",
        "permission is hereby granted free of charge to any person obtaining a copy",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind",
    ),
    "isc": ("isc license", "permission to use copy modify and or distribute this software for any purpose"),
    "hpnd": ("permission to use copy modify and distribute this software and its documentation for any purpose",),
    "bsd": (
        "redistribution and use in source and binary forms", "bsd license", "bsd style license",
        "use of this source code is governed by a bsd style license", "redistributions of source code must retain the above copyright notice",
        "redistributions in binary form must reproduce the above copyright notice",
    ),
    "bsd-2-clause": ("bsd 2 clause", "2 clause bsd", "simplified bsd license", "two clause bsd", "freebsd license"),
    "bsd-3-clause": (
        "bsd 3 clause", "3 clause bsd", "new bsd license", "modified bsd license", "revised bsd license",
        "neither the name of w nor the names of its contributors", "neither the name of w nor the names of w contributors may be used",
    ),
    "bsd-4-clause": ("bsd 4 clause", "4 clause bsd", "original bsd license", "all advertising materials mentioning features or use of this software"),
    "0bsd": ("bsd zero clause", "zero clause bsd", "0bsd"),
    "zlib": (
        "zlib license", "zlib libpng license", "altered source versions must be plainly marked",
        "the origin of this software must not be misrepresented", "in no event will the authors be held liable for any damages arising from the use of this software",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software",
    ),
    "public-domain": (
        "released into the public domain", "dedicated to the public domain", "is in the public domain", "placed in the public domain",
        "hereby released to the public domain", "public domain mark", "this work is free of known copyright restrictions",
        "no rights reserved", "work of the united states government",
    ),
    "cc0": ("cc0", "creative commons zero", "the person who associated a work with this deed has dedicated the work to the public domain"),
    "wtfpl": ("do what the fuck you want to public license", "you just do what the fuck you want to", "wtfpl"),
    "beerware": ("beer ware license", "beerware license", "you can buy me a beer in return"),
    "postgresql": ("postgresql license",),
    "ncsa": ("university of illinois ncsa open source license",),
    "x11": ("x11 license", "x consortium license", "except as contained in this notice the name of the x consortium"),
    "w3c": ("w3c software notice and license", "w3c software and document notice", "w3c document license"),
    "openssl": ("openssl license", "this product includes software developed by the openssl project"),
    "libpng": ("libpng license", "this code is released under the libpng license"),
    "json": ("the software shall be used for good not evil",),
    "unicode": ("unicode license agreement", "unicode terms of use"),
    "ftl": ("freetype project license", "freetype license"),
    "ijg": ("this software is based in part on the work of the independent jpeg group",),
    "tcl": ("this software is copyrighted by the regents of the university of california sun microsystems",),
    "vim": ("vim license",),
    "ruby": ("ruby license", "ruby s license"),
    "python": ("psf is making python available to licensee",),
    "upl": ("universal permissive license",),
    "ms-pl": ("microsoft public license",),
    "ms-rl": ("microsoft reciprocal license",),
    "busl-1.1": ("business source license 1 1",),
    "sspl": ("server side public license",),
    "elastic": ("elastic license 2 0", "elastic license"),
    "commons-clause": ("commons clause license condition", "commons clause"),
    "polyform": ("polyform noncommercial license", "polyform small business license", "polyform shield license"),
    "pddl": ("public domain dedication and license",),
    "odc-by": ("open data commons attribution license",),
    "ogl-uk": ("open government licence",),
    "etalab": ("licence ouverte", "open licence etalab"),
    "cc": ("some rights reserved", "licensed under a creative commons", "creative commons license"),
    "noncommercial": ("for non commercial use only", "for noncommercial use only", "for personal use only", "for research purposes only", "not for commercial use"),
    "evaluation": ("for evaluation purposes only", "trial license agreement"),
    "commercial": ("commercial license", "end user license agreement", "proprietary and confidential", "software license agreement", "licensed not sold"),
    "confidential": ("confidential and proprietary", "trade secrets? of w", "unauthorized copying of this file via any medium is strictly prohibited"),
    "reserved": (
        "all rights are reserved", "no part of this w may be reproduced", "may not be reproduced without w permission", "reproduction without permission is prohibited",
        "reproduction in whole or in part", "may not be published broadcast rewritten or redistributed", "unauthorized reproduction is prohibited",
        "alle rechte vorbehalten", "tous droits reserves", "tous droits réservés", "todos los derechos reservados", "todos os direitos reservados", "tutti i diritti riservati",
    ),
    "terms": ("subject to our terms of use", "subject to the terms of service", "by using this site you agree to"),
    "courtesy": ("reprinted with permission", "used with permission", "reproduced with permission"),
    "copyright": ("copyright c (?:19|20)[0-9]{2}", "copyright (?:19|20)[0-9]{2}", "c copyright (?:19|20)[0-9]{2}"),
}

# Where overlapping detections compete, a higher priority wins.
TAG, URL, NOTICE, NAME, SHORT = 50, 40, 30, 20, 10


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    weight: float
    keywords: frozenset[bytes]
    pattern: re.Pattern[bytes]


def _rule(label: str, priority: int, weight: float, pattern: str) -> Rule:
    """Keywords are the plain words of the pattern, all of which a match must hold."""
    words = re.sub(r"\(\?:[^)]*\)\S*|\[[^\]]*\]\S*", "?", pattern).split()
    keywords = frozenset(w.encode() for w in words if re.fullmatch(r"[0-9a-z]+", w) and w != "w")
    spaced = re.sub(r"(?<!\S)w(?!\S)", "(?:\\\\S+ ){0,5}\\\\S+", pattern)
    return Rule(label, priority, weight, keywords, re.compile(rf"(?<!\S){spaced}(?!\S)".encode()))


def rules() -> list[Rule]:
    """All rules in the order of their priority, longer patterns first."""
    found: dict[tuple[str, str], Rule] = {}

    def add(label: str, priority: int, weight: float, pattern: str) -> None:
        found.setdefault((label, pattern), _rule(label, priority, weight, pattern))

    for family, (versions, names) in VERSIONED.items():
        for version in versions:
            label = f"{family}-{version.replace(' ', '.')}"
            for ending, suffix in (("", ""), (" only", "-only"), (" or later", "-or-later")):
                add(label + suffix, TAG, 0.99, f"spdx license identifier {family} {version}(?: 0)?{ending}")
            add(label, URL, 0.95, f"licenses (?:license |old licenses )?{family} {version}")
            for name in names:
                glue = "" if name.endswith("v") else " "
                add(label, NAME, 0.9, f"{name}{glue}{version}")
                if glue:
                    add(label, NAME, 0.9, f"{name} (?:version |v ?){version}")
                    add(f"{label}-only", NAME, 0.9, f"{name} (?:version |v ?)?{version} only")
                    add(f"{label}-or-later", NAME, 0.9, f"{name} (?:version |v ?)?{version} or (?:any )?later")
        for name in names:
            if not name.endswith("v"):
                add(family, SHORT, 0.5 if " " in name else 0.3, name)
    for short, long in CC_ELEMENTS.items():
        tail = f" {short}" if short else ""
        label = f"cc-by{tail}".replace(" ", "-")
        spelled = f"attribution {long}" if short else "attribution"
        add(label, SHORT, 0.6, f"cc by{tail}")
        for version in CC_VERSIONS:
            dotted = version.replace(" ", ".")
            add(f"{label}-{dotted}", TAG, 0.99, f"spdx license identifier cc by{tail} {version}")
            add(f"{label}-{dotted}", URL, 0.95, f"creativecommons org licenses by{tail} {version}")
            add(f"{label}-{dotted}", NAME, 0.9, f"cc by{tail} {version}")
            add(f"{label}-{dotted}", NAME, 0.9, f"creative commons {spelled} {version}")
    for words, label in SPDX.items():
        add(label, TAG, 0.99, f"spdx license identifier {words}")
    for words, label in ADDRESSES.items():
        add(label, URL, 0.95, words)
    for label, phrases in NOTICES.items():
        for phrase in phrases:
            add(label, NOTICE, 0.8 if label != "copyright" else 0.2, phrase)
    for phrase, label in BASE.items():
        add(label, SHORT, 0.4, phrase)
    return sorted(found.values(), key=lambda r: (-r.priority, -len(r.pattern.pattern), r.label))


@dataclass(frozen=True)
class Index:
    """Rules in order, and for each keyword the rules of which it is the rarest."""

    ruled: list[Rule]
    by_keyword: dict[bytes, list[int]]


def index(ruled: list[Rule]) -> Index:
    """Rare is a keyword that few rules share, then a long one."""
    shared = Counter(k for r in ruled for k in r.keywords)
    by_keyword: dict[bytes, list[int]] = {}
    for number, rule in enumerate(ruled):
        by_keyword.setdefault(min(rule.keywords, key=lambda k: (shared[k], -len(k), k)), []).append(number)
    return Index(ruled, by_keyword)


def candidates(present: set[bytes], indexed: Index) -> list[int]:
    """Numbers, in order, of the rules all of whose keywords are present."""
    found = [n for k in indexed.by_keyword.keys() & present for n in indexed.by_keyword[k]]
    return sorted(n for n in found if indexed.ruled[n].keywords <= present)


def detections(words: list[bytes], indexed: Index) -> list[tuple[int, int, Rule]]:
    """(start, end, rule) in bytes of the joined words, contained ones suppressed."""
    numbers = candidates(set(words), indexed)
    joined = b" ".join(words) if numbers else b""
    accepted: list[tuple[int, int, Rule]] = []
    starts: list[int] = []  # of the accepted, in order, and the furthest end up to each
    reach: list[int] = []
    for rule in map(indexed.ruled.__getitem__, numbers):
        new = []
        for m in rule.pattern.finditer(joined):
            before = bisect_right(starts, m.start())
            if not before or reach[before - 1] < m.end():
                new.append((m.start(), m.end(), rule))
        if new:
            accepted = sorted(accepted + new, key=lambda d: d[:2])
            starts = [d[0] for d in accepted]
            reach = list(accumulate((d[1] for d in accepted), max))
    return accepted


_BASE = [(tuple(p.encode().split()), re.compile(rf"(?<!\S){p}(?!\S)".encode()), label) for p, label in BASE.items()]


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(word number, label) of every place where a base phrase stands."""
    present, found = set(words), []
    joined: bytes | None = None
    for phrase, pattern, label in _BASE:
        if present.issuperset(phrase):
            joined = b" ".join(words) if joined is None else joined
            at = word = 0
            for m in pattern.finditer(joined):
                word += joined.count(b" ", at, m.start())
                at = m.start()
                found.append((word, label))
    return found


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, n_detections long, spans array<struct<first_word:long,last_word:long,label:string>>"
)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: base counts and labels, all labels, a score and the spans.

    `score` is the chance that at least one kept detection is right, by the weights of the
    rules; 0 without any. Null and empty texts have no words, no label ("") and score 0; a
    null doc_id stays null; repeated rows are repeated; other columns are not read. Each
    document is judged alone: there is nothing to shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ruled = index(rules())
        for batch in batches:
            yield pd.DataFrame(
                [_scan_one(i, t, ruled) for i, t in zip(batch["doc_id"], batch["text"], strict=True)],
                columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_detections", "spans"],
            ).astype({c: "Int64" for c in ("doc_id", "first_word", "last_word")})

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInPandas(run, SCHEMA)


def _scan_one(doc_id, text: str | None, ruled: Index) -> tuple:
    words = alnum_words(text)
    places = base_places(words)
    kept = detections(words, ruled)
    joined = b" ".join(words) if kept else b""
    base = {label for _, label in places}
    unsure, spans, at, first = 1.0, [], 0, 0
    for s, e, rule in kept:
        unsure *= 1 - rule.weight
        first, at = first + joined.count(b" ", at, s), s
        spans.append({"first_word": first, "last_word": first + joined.count(b" ", s, e), "label": rule.label})
    starts = [w for w, _ in places]
    return (
        None if pd.isna(doc_id) else int(doc_id),
        len(words),
        len(places),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(base | {r.label for _, _, r in kept})),
        1 - unsure,
        len(kept),
        spans,
    )

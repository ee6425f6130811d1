"""License scans by sentence rules.

A text is cut into sentences after closing punctuation, at empty lines and where a line begins like a known
sentence or a list's item. Other line ends, and the prefixes of comments, are joined over; where the joined
lines are no known sentence, each line counts by itself. Only sentences with a key word are looked at further. They are normalised (lower case, spelling of licence,
white space, quotes, punctuation), and names of licences, versions, subjects (this file is) and verbs (released, distributed) are
put in one form each. The normalised sentence is then looked up: whole, by its first words, or as what stands before and behind a licence's name.
What is found is the identifier of a known licence sentence, with its version; so a sentence that denies
a licence is none. The sequence of a document's identifiers, in order, is then matched against ordered
rules: a rule names identifiers that follow each other and the licence that they stand for. The first
rule that matches at a place takes its identifiers; what no rule takes is reported as unmatched, and so is every sentence
that has a word of STATES and no identifier, as UNKNOWN with a hash of its normalised form. A sentence may name
several licences with and, or or commas between them; each is listed.

SPDX expressions are parsed (with brackets, AND, OR, WITH and +) and written with the licences' own spelling and no brackets
but those that are needed. What doesn't parse is an unknown sentence.

Cases: null and empty texts have no sentences and no licences. Very long texts are scanned as a whole. Repeated rows
get equal results, null doc_ids are kept, extra columns are ignored. The same licence stated twice is listed once.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ledgerlark.llm._shared import bound_batches

# The words without which a sentence states no licence.
KEYS = r"licen[cs]|copyright|copyleft|redistribut|spdx|warrant|permission|permitted|merchantab|public domain|all rights reserved|liable|endorse|creative commons|as is|\bcc0\b|\b[al]?gpl"

# Those of them that a sentence about a licence has; with none of these, one that isn't known isn't reported.
STATES = r"licen[cs]|copyright|copyleft|redistribut|spdx"

# Names of licences, without "the" in front and "license" behind, in lower case.
NAMES: dict[str, str] = {
    "gnu affero general public": "AGPL", "affero general public": "AGPL", "gnu agpl": "AGPL", "agpl": "AGPL",
    "gnu lesser general public": "LGPL", "lesser general public": "LGPL", "gnu library general public": "LGPL", "library general public": "LGPL", "gnu lgpl": "LGPL", "lgpl": "LGPL",
    "gnu general public": "GPL", "general public": "GPL", "gnu gpl": "GPL", "gpl": "GPL",
    "apache software": "APACHE", "apache": "APACHE", "mozilla public": "MPL", "mpl": "MPL", "mit": "MIT", "isc": "ISC", "unlicense": "UNLICENSE_NAME",
    "2-clause bsd": "BSD2", "bsd 2-clause": "BSD2", "bsd-2-clause": "BSD2", "simplified bsd": "BSD2", "4-clause bsd": "BSD4", "bsd 4-clause": "BSD4", "bsd-4-clause": "BSD4", "original bsd": "BSD4",
    "3-clause bsd": "BSD3", "bsd 3-clause": "BSD3", "bsd-3-clause": "BSD3", "new bsd": "BSD3", "modified bsd": "BSD3", "bsd-style": "BSD3", "bsd": "BSD3",
    "cc0": "CC0", "creative commons zero": "CC0", "creative commons cc0": "CC0",
    "boost software": "BOOST", "boost": "BOOST", "eclipse public": "EPL", "epl": "EPL", "eclipse distribution": "EDL", "zlib": "ZLIB", "zlib/libpng": "ZLIB", "artistic": "ARTISTIC", "perl artistic": "ARTISTIC",
    "european union public": "EUPL", "eupl": "EUPL", "common development and distribution": "CDDL", "cddl": "CDDL", "common public": "CPL", "postgresql": "POSTGRESQL", "python software foundation": "PSF", "psf": "PSF",
    "do what the fuck you want to public": "WTFPL", "wtfpl": "WTFPL", "sil open font": "OFL", "open font": "OFL", "university of illinois/ncsa open source": "NCSA", "ncsa": "NCSA", "microsoft public": "MSPL", "ms-pl": "MSPL",
    "open software": "OSL", "academic free": "AFL", "open data commons open database": "ODBL", "open database": "ODBL", "odbl": "ODBL", "universal permissive": "UPL", "zero-clause bsd": "BSD0", "bsd zero clause": "BSD0", "0bsd": "BSD0", "0-clause bsd": "BSD0",
    "x11": "X11", "blue oak model": "BLUEOAK", "server side public": "SSPL", "sspl": "SSPL", "educational community": "ECL",
}
# Names that are words of their own too, and name a licence only before "license" or behind "under".
WORDS = ("mit", "isc", "apache", "bsd", "boost", "zlib", "artistic", "postgresql", "x11", "psf", "ncsa", "epl", "cddl")
# What a sentence that names a licence has in front of the name.
HEADS = frozenset(
    [
        "licensed under", "under", "is under", "are under", "free software licensed under", "free software under", "subject to", "it under", "modify it under", "redistribute it and/or modify it under",
        "you can redistribute it and/or modify it under", "free software you can redistribute it and/or modify it under", "you may use distribute and modify this code under", "license", "licensed",
    ]
)
_FSF = "as published by the free software foundation"
# What it has behind the name, where V is a version. True: any later version will do as well.
RESTS: dict[str, bool] = {"": False, "V": False, "only": False, "V only": False, "alone": False, _FSF: False} | {
    f"{a}{b}": later for a in ("", f"{_FSF} ") for b, later in [("V of the license", False), ("either V of the license", False), *((f"{v}or {o}any later version", True) for v in ("", "V ", "either V ", "V of the license ", "either V of the license ") for o in ("", "at your option ")), *((f"{v}or {w}", True) for v in ("", "V ", "V of the license ") for w in ("later", "newer", "above"))]
}
# What may follow that and says nothing.
TAILS = ("the license", "license", "see the license file for details", "see the license file for more details", "see license for details", "see the accompanying license file", "see license", "see license file", "see the license file", "with the following terms", "international", "unported", "generic",
    *(f"{a} otherwise {b}" for a in ("unless", "except where", "except as") for b in ("noted", "stated", "specified", "indicated")), "see license for more information", "see the license file for more information", "for details", "for more details", "whichever you prefer", "as well", "which accompanies this distribution", "a copy of which is included")
# The head of the sentence that only repeats a licence's name.
COPY_HEAD = "you should have received a copy of"

# Whole sentences, without their subject.
WHOLE: dict[str, str] = {
    "either V of the license or at your option any later version": "LATER", "or at your option any later version": "LATER", "or any later version": "LATER",
    "in the public domain": "PUBLIC_DOMAIN", "public domain": "PUBLIC_DOMAIN", "released into the public domain": "PUBLIC_DOMAIN", "licensed into the public domain": "PUBLIC_DOMAIN", "dedicated to the public domain": "PUBLIC_DOMAIN",
    "hereby dedicated to the public domain": "PUBLIC_DOMAIN", "placed in the public domain": "PUBLIC_DOMAIN", "hereby placed in the public domain": "PUBLIC_DOMAIN", "placed into the public domain": "PUBLIC_DOMAIN", "hereby released into the public domain": "PUBLIC_DOMAIN",
    "free and unencumbered software released into the public domain": "UNLICENSE", "free and unencumbered software licensed into the public domain": "UNLICENSE", "all rights reserved": "RESERVED",
}
# First words of sentences whose ends differ, and words that have to follow somewhere.
OPENINGS: dict[str, tuple[str, str]] = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software": ("MIT_GRANT", ""),
    "the above copyright notice and this permission notice shall be included in all copies": ("MIT_NOTICE", ""),
    "permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted": ("ISC_GRANT", ""),
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": ("ISC_GRANT", ""),
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee": ("PG_GRANT", "without a written agreement"),
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation": ("BOOST_GRANT", ""),
    "the copyright notices in the software and this entire statement including the above license grant": ("BOOST_NOTICE", ""),
    "this software is provided as is without any express or implied warranty": ("ZLIB_AS_IS", ""),
    "this software is provided as-is without any express or implied warranty": ("ZLIB_AS_IS", ""),
    "in no event will the authors be held liable for any damages": ("ZLIB_LIABLE", ""),
    "permission is granted to anyone to use this software for any purpose including commercial applications": ("ZLIB_GRANT", ""),
    "the origin of this software must not be misrepresented": ("ZLIB_ORIGIN", ""),
    "altered source versions must be plainly marked as such": ("ZLIB_ALTERED", ""),
    "this notice may not be removed or altered from any source distribution": ("ZLIB_NOTICE", ""),
    "anyone is free to copy modify publish use compile sell or distribute this software": ("UNLICENSE_FREE", ""),
    "you just do what the fuck you want to": ("WTFPL_GRANT", ""),
    "all advertising materials mentioning features or use of this software must display": ("BSD_ADVERT", "acknowledg"),
    "the software is provided as is": ("AS_IS", ""),
    "in no event shall the author": ("LIABLE", "liable"),
    "in no event shall the authors": ("LIABLE", "liable"),
    "in no event shall the copyright": ("LIABLE", "liable"),
    "redistribution and use in source and binary forms with or without modification are permitted": ("BSD_GRANT", ""),
    "redistributions of source code must retain": ("BSD_SOURCE", ""),
    "redistributions in binary form must reproduce": ("BSD_BINARY", ""),
    "neither the name of": ("BSD_ENDORSE", "endorse or promote"),
    "this software is provided by": ("BSD_AS_IS", "as is"),
    "you may not use this file except in compliance with the license": ("APACHE_USE", ""),
    "you may obtain a copy of the license at": ("APACHE_COPY", ""),
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": ("APACHE_BASIS", ""),
    "see the license for the specific language governing permissions and limitations under the license": ("APACHE_LANG", ""),
}

# Rules in order; a name ends in ? where the sentence may be missing. %s is the first version that its sentences give, after its default.
RULES: list[tuple[str, str | None, tuple[str, ...]]] = [
    ("%s", None, ("SPDX",)),
    ("Apache-%s", "2.0", ("APACHE", "APACHE_USE?", "APACHE_COPY?", "APACHE_BASIS?", "APACHE_LANG?")),
    ("MIT", None, ("MIT_GRANT", "MIT_NOTICE", "AS_IS?", "LIABLE?")),
    ("MIT", None, ("MIT",)),
    ("ISC", None, ("ISC_GRANT", "AS_IS?", "LIABLE?")),
    ("0BSD", None, ("ZERO_GRANT", "AS_IS?", "LIABLE?")),
    ("PostgreSQL", None, ("PG_GRANT", "AS_IS?", "LIABLE?")),
    ("BSL-1.0", None, ("BOOST_GRANT", "BOOST_NOTICE?", "AS_IS?", "LIABLE?")),
    ("Zlib", None, ("ZLIB_AS_IS?", "ZLIB_LIABLE?", "ZLIB_GRANT", "ZLIB_ORIGIN?", "ZLIB_ALTERED?", "ZLIB_NOTICE?")),
    ("WTFPL", None, ("WTFPL_GRANT",)),
    ("AGPL-%s-or-later", "3.0", ("AGPL_LATER", "LATER?", "GPL_COPY?")),
    ("AGPL-%s-or-later", "3.0", ("AGPL", "LATER", "GPL_COPY?")),
    ("AGPL-%s-only", "3.0", ("AGPL", "GPL_COPY?")),
    ("LGPL-%s-or-later", "2.1", ("LGPL_LATER", "LATER?", "GPL_COPY?")),
    ("LGPL-%s-or-later", "2.1", ("LGPL", "LATER", "GPL_COPY?")),
    ("LGPL-%s-only", "2.1", ("LGPL", "GPL_COPY?")),
    ("GPL-%s-or-later", "2.0", ("GPL_LATER", "LATER?", "GPL_COPY?")),
    ("GPL-%s-or-later", "2.0", ("GPL", "LATER", "GPL_COPY?")),
    ("GPL-%s-only", "2.0", ("GPL", "GPL_COPY?")),
    ("MPL-%s", "2.0", ("MPL",)),
    ("BSD-4-Clause", None, ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ADVERT", "BSD_ENDORSE?", "BSD_AS_IS?", "LIABLE?")),
    ("BSD-3-Clause", None, ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_ENDORSE", "BSD_AS_IS?", "LIABLE?")),
    ("BSD-2-Clause", None, ("BSD_GRANT", "BSD_SOURCE", "BSD_BINARY", "BSD_AS_IS?", "LIABLE?")),
    ("BSD-2-Clause", None, ("BSD2",)),
    ("BSD-3-Clause", None, ("BSD3",)),
    ("BSD-4-Clause", None, ("BSD4",)),
    ("ISC", None, ("ISC",)),
    ("CC0-1.0", None, ("CC0",)),
    ("CC-%s", "BY-4.0", ("CC",)),
    ("BSL-1.0", None, ("BOOST",)), ("EPL-%s", "2.0", ("EPL",)), ("BSD-3-Clause", None, ("EDL",)), ("Zlib", None, ("ZLIB",)), ("Artistic-%s", "2.0", ("ARTISTIC",)), ("EUPL-%s", "1.2", ("EUPL",)), ("CDDL-%s", "1.0", ("CDDL",)), ("CPL-%s", "1.0", ("CPL",)),
    ("PostgreSQL", None, ("POSTGRESQL",)), ("PSF-%s", "2.0", ("PSF",)), ("WTFPL", None, ("WTFPL",)), ("OFL-%s", "1.1", ("OFL",)), ("NCSA", None, ("NCSA",)), ("MS-PL", None, ("MSPL",)), ("OSL-%s", "3.0", ("OSL",)), ("AFL-%s", "3.0", ("AFL",)), ("ODbL-%s", "1.0", ("ODBL",)),
    ("UPL-%s", "1.0", ("UPL",)), ("0BSD", None, ("BSD0",)), ("X11", None, ("X11",)), ("BlueOak-%s", "1.0.0", ("BLUEOAK",)), ("SSPL-%s", "1.0", ("SSPL",)), ("ECL-%s", "2.0", ("ECL",)),
    ("Unlicense", None, ("UNLICENSE", "UNLICENSE_FREE?", "PUBLIC_DOMAIN?", "AS_IS?", "LIABLE?")),
    ("Unlicense", None, ("UNLICENSE_NAME",)),
    ("public-domain", None, ("PUBLIC_DOMAIN",)),
    ("proprietary", None, ("RESERVED",)),
]
# How licences are spelled in SPDX expressions, besides those that RULES give.
SPELLED = (
    "MIT-0 Apache-1.1 Apache-2.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later "
    "AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later MPL-1.1 MPL-2.0 EPL-1.0 EPL-2.0 CDDL-1.0 CDDL-1.1 CPL-1.0 Artistic-1.0 Artistic-2.0 EUPL-1.1 EUPL-1.2 OFL-1.1 OSL-3.0 AFL-3.0 ODbL-1.0 UPL-1.0 BlueOak-1.0.0 SSPL-1.0 ECL-2.0 PSF-2.0 Python-2.0 "
    "CC-BY-3.0 CC-BY-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-NC-ND-4.0 CC-PDDC BSD-2-Clause-Patent BSD-3-Clause-Clear NONE NOASSERTION "
    "Classpath-exception-2.0 LLVM-exception GCC-exception-2.0 GCC-exception-3.1 Linux-syscall-note Autoconf-exception-3.0 Bison-exception-2.2 Font-exception-2.0 OpenSSL curl Ruby Vim PHP-3.01 libpng-2.0 W3C LPPL-1.3c"
).split()

CUT = re.compile(r"(?<=[.!?;])\s+(?=[A-Z\"“(*0-9])")
KEY = re.compile(KEYS)
STATE = re.compile(STATES)
#: in a text, where the words of a key may be on two lines
KEY_IN_TEXT = re.compile((KEYS + "|(?:released|distributed|available|published|provided|offered) under ").replace(" ", r"[\s#*/;%<>!-]+"))
COMMENT = re.compile(r"\s*(?:(?://+|/\*+|\*+/?|#+|;+|--+|%+|<!--+)\s*)?")
CLOSED = re.compile(r"[.!?;:][\"'”)\s]*$")
BEGINS = re.compile(
    r"(?:[-•(]?\(?[0-9a-z][.)] )|(?=[A-Z(©\"“])[\"“]?(?i:spdx-|(?:this (?:work|file|software|project|program|library) is )?(?:released|licensed|distributed|available|free software|free and unencumbered|provided|dedicated) |this (?:work|file|software|project|program|library) is |everything |the (?:above copyright notice|software is provided)|permission (?:is hereby|to use)|you (?:may|should) |unless required|see the license|in no event|either version|redistributions? |neither the name|all rights reserved|copyright (?:\(c\)|©|[0-9])|(?:\(c\)|©) ?copyright)"
)
VERSIONED = r"(?:(?:[ -]?(?:version|v\.?)?|, (?:version|v\.?)) ?(?P<v>[0-9]+(?:\.[0-9]+)*)(?P<plus>\+)?)"
NAME = re.compile(r"(?<![\w-])(?:the |an? )?(?:(?P<cc>(?:creative commons|cc)[ -](?P<by>(?:attribution|by)(?:[ -](?:noncommercial|nc|sharealike|sa|noderivatives|noderivs|nd))*))|(?P<name>" + "|".join(sorted(map(re.escape, NAMES), key=len, reverse=True)) + r"))(?!(?!v\d)[a-z]|-(?!or-later|only)[a-z])(?: licenses?)?" + VERSIONED + "?(?: licenses?)?")
# The codes of the terms of Creative Commons.
CC_CODES = {"attribution": "by", "noncommercial": "nc", "sharealike": "sa", "noderivatives": "nd", "noderivs": "nd"}
VERSION = re.compile(r"\b(?:version|v\.?) ?([0-9]+(?:\.[0-9]+)*)")
ITEM = re.compile(r"^(?:[*•-] ?|\(?[0-9a-z][.)] )+")
SUBJECT = re.compile(r"^(?:(?:this|the) (?:work|file|software|project|program|library|package|module|source code(?: form)?|code|document) (?:is |are )?(?=(?:hereby |licensed|released|distributed|available|made |provided |published|free |subject |under |in the public|public domain|dedicated|placed|you can))|this is (?=free )|[\w .-]{1,60}? is (?=free software[ ,:;]))")
#: of a sentence that says this of anything, unless it denies, doubts or tells of the past
ANYTHING = re.compile(r"^(?!.*\b(?:not|no|nor|nothing|none|neither|never|without|cannot|isnt|arent|if|unless it|whether|when|until|would|could|might|was|were|formerly|previously|which|that)\b)[\w .,/-]{1,80}? (?:is|are)(?: also| both)? (?=(?:(?:dual|double|multi|triple)-)?(?:licensed|released|distributed|available|made available|published|provided|offered) under\b)")
EITHER = re.compile(r"\bunder (?:either|any|one|both|your choice)(?: of)? ")
UNDER = re.compile(r"\b(under|subject to|of) (?:the |an? )?(?:terms|conditions|terms and conditions)(?: and conditions)? of ")
VERB = re.compile(r"\b(?:(?:dual|double|multi|triple)-)?(?:licensed|released|distributed|available|made available|published|provided|offered)(?= under\b)")
MARKS = re.compile(r"[,;:()\[\]\"']+|(?<!\S)[-–—]+(?!\S)")
UNDER_NAME = re.compile(r"(?:under|license:?|licensed) *(?:the |an? )?$")
BEGUN = {tuple(k.split(" ", 3)[:3]) for k in OPENINGS}
OPENING_SIZES = sorted({len(k.split()) for k in OPENINGS})
SPDX = re.compile(r"\W*spdx-license-identifier:\s*(.*?)[\s*/#;>-]*$", re.IGNORECASE)
TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9.+-]+(?::[A-Za-z0-9.+-]+)?)")
ENDING = re.compile(r"(-or-later|-only)(?![\w-])")
#: what may stand between two licences of one sentence
JOINT = re.compile(r"[\s,]*(?:(?:and/or|and|or|/|&|,)[\s,]*)(?:(?:under|either|also)\s+)*(?:the (?:terms of )?|an? )?")
COPYRIGHT = re.compile(r"copyright (?:\(c\)|©|[0-9]{4}).*|(?:\(c\)|©) ?copyright.*")
STRIP = " \t\r.,;:!\"'*#/-<>"


_SPELLED = {x.lower(): x for x in (*SPELLED, *(licence for licence, _, _ in RULES if "%" not in licence))}


def expression(text: str) -> str | None:
    """An SPDX expression in its usual spelling, or None if it isn't one. AND binds closer than OR."""
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            return None
        tokens.append(m[1])
        at = m.end()
    place = 0

    def peek() -> str:
        return tokens[place].upper() if place < len(tokens) else ""

    def take() -> str:
        nonlocal place
        place += 1
        return tokens[place - 1]

    def one() -> tuple[str, int] | None:
        if peek() == "(":
            take()
            inner = either()
            return inner if inner and peek() == ")" and take() else None
        if peek() in ("", ")", "AND", "OR", "WITH"):
            return None
        name = take()
        out = _SPELLED.get(name.lower()) or (_SPELLED.get(name[:-1].lower(), name[:-1]) + "+" if name.endswith("+") else name)
        if peek() == "WITH":
            take()
            if peek() in ("", "(", ")", "AND", "OR", "WITH"):
                return None
            extra = take()
            out += f" WITH {_SPELLED.get(extra.lower(), extra)}"
        return out, 2

    def chain(part, word: str, rank: int) -> tuple[str, int] | None:
        """part, or parts with word between; rank is how close they bind."""
        found = [part()]
        while found[-1] and peek() == word:
            take()
            found.append(part())
        if not found[-1]:
            return None
        if len(found) == 1:
            return found[0]
        return f" {word} ".join(f"({x})" if r < rank else x for x, r in found), rank

    def both() -> tuple[str, int] | None:
        return chain(one, "AND", 1)

    def either() -> tuple[str, int] | None:
        return chain(both, "OR", 0)

    whole = either()
    return whole[0] if whole and place == len(tokens) else None


def normalise(sentence: str) -> str:
    s = sentence.lower().replace("licence", "license").replace("“", '"').replace("”", '"').replace('"', "").replace("'", "")
    return re.sub(r"\s+", " ", s).strip(STRIP)


def _sentences(text: str):
    """The parts of each sentence, line by line."""
    open_: list[str] = []
    for line in text.split("\n"):
        line = line[COMMENT.match(line).end() :].removesuffix("*/").removesuffix("-->").rstrip()
        # a version behind a semicolon belongs to its licence
        if open_ and (not line or BEGINS.match(line) or (CLOSED.search(open_[-1]) and not (open_[-1].endswith(";") and line.lower().startswith(("version", "either version"))))):
            yield open_
            open_ = []
        if not line:
            continue
        first, *others = CUT.split(line)
        open_.append(first)
        for other in others:
            yield open_
            open_ = [other]
        if open_[-1].lower().startswith("spdx-"):
            yield open_
            open_ = []
    if open_:
        yield open_


def canonical(sentence: str) -> tuple[str, list[tuple[str, str, str | None]], str | None]:
    """The normalised sentence in one form: what is in front of the first licence's name, for each licence its name's identifier, what is behind it and its version, and the first version of all. Without a name all is in front."""
    s = ITEM.sub("", sentence)
    version = None

    def plain(t: str) -> str:
        nonlocal version
        if version is None and (m := VERSION.search(t)):
            version = m[1]
        return " ".join(MARKS.sub(" ", VERSION.sub("V", t)).split())

    m = NAME.search(s)
    while m and m["name"] in WORDS and "license" not in m[0] and not UNDER_NAME.search(s[: m.start()]):
        # words that are names only as such
        m = NAME.search(s, m.end())
    if not m:
        front = plain(UNDER.sub(r"\1 ", s))
        return _form(front), [], version
    front = _form(plain(EITHER.sub("under ", UNDER.sub(r"\1 ", s[: m.start()] + "\0").replace("\0", " "))))
    found = []
    while m:
        ending = ENDING.match(s, m.end())
        joint = JOINT.match(s, ending.end() if ending else m.end())
        after = NAME.match(s, joint.end()) if joint else None
        behind = "" if after else s[m.end() :]
        if m["v"]:
            version = m["v"]
        name = NAMES[m["name"]] if m["name"] else "CC"
        if name == "CC":
            codes = [CC_CODES.get(w, w) for w in re.split("[ -]", m["by"])]
            version = "-".join([codes[0], *codes[1:]]) + (f" {m['v']}" if m["v"] else "")
        if ending:
            # of a name with its version: -or-later, -only
            behind = s[ending.end() :] if not after else ""
        rest = plain(("or later " if m["plus"] else ending[1].replace("-", " ").strip() + " " if ending else "") + behind)
        found.append((name, rest, version))
        m, version = after, None if after else version
    return front, found, found[0][2]


def _form(front: str) -> str:
    front = front + " "
    front = ANYTHING.sub("", SUBJECT.sub("", front, count=1), count=1).strip() + " under "
    return VERB.sub("licensed", front).removesuffix(" under ").strip()


def _without_tail(rest: str) -> str:
    while tail := next((t for t in TAILS if rest == t or rest.endswith(" " + t)), None):
        rest = rest[: len(rest) - len(tail)].strip()
    return rest


def _known(sentence: str) -> list[tuple[str, str | None]]:
    """The identifiers of a sentence and their versions, by look-ups of its normalised form; none if it isn't known."""
    s = normalise(sentence)
    if not s or not (KEY.search(s) or NAME.search(s) or s.startswith(("either version", "or (at your option", "or at your option", "this is free and unencumbered")) or tuple(ITEM.sub("", s).split(" ", 3)[:3]) in BEGUN):
        return []
    if m := SPDX.match(sentence):
        found = expression(m[1])
        return [("SPDX", found)] if found else []
    if s.endswith("all rights reserved"):
        return [("RESERVED", None)]
    front, names, version = canonical(s)
    if names and front == COPY_HEAD:
        return [("GPL_COPY", None)]
    if names and front in HEADS:
        rests = [rest if rest in RESTS else _without_tail(rest) for _, rest, _ in names]
        if len(names) > 1:
            rests[-1] = rests[-1] if rests[-1] in RESTS else _without_tail(rests[-1].removesuffix("at your option").strip())
        if all(rest in RESTS for rest in rests):
            return [(f"{name}_LATER" if RESTS[rest] and name in ("GPL", "LGPL", "AGPL") else name, v) for (name, _, v), rest in zip(names, rests)]
    whole = " ".join(MARKS.sub(" ", ITEM.sub("", s)).split())
    if found := WHOLE.get(front if not names else _form(" ".join(VERSION.sub("V", whole).split()))):
        return [(found, version)]
    words = whole.split(" ")
    for n in reversed(OPENING_SIZES):
        if n <= len(words) and (found := OPENINGS.get(" ".join(words[:n]))) and found[1] in whole:
            # the same words without a condition on the notice are another licence
            return [("ZERO_GRANT" if found[0] == "ISC_GRANT" and "notice" not in whole else found[0], None)]
    return [("COPYRIGHT", None)] if COPYRIGHT.fullmatch(s) else []


def identify(text: str) -> list[tuple[str, str | None]]:
    """(identifier, version) of the licence sentences, in order; UNKNOWN and a hash of those that state something else."""
    if not KEY_IN_TEXT.search(text.lower()):
        return []
    found = []
    for parts in _sentences(text):
        whole = _known(" ".join(parts))
        if whole:
            found += whole
            continue
        for part in parts:
            known = _known(part)
            found += known
            if not known and STATE.search(s := normalise(part)):
                found.append(("UNKNOWN", hashlib.sha256(s.encode()).hexdigest()[:12]))
    return found


def _version(licence: str, default: str | None, version: str | None) -> str:
    if "%s" not in licence:
        return licence
    if version is None:
        return licence % default
    version = version.strip(".")
    if licence.startswith("CC-"):
        version = version.upper().replace(" ", "-")
    elif re.fullmatch(r"[0-9]+", version) and not licence.startswith("BSD"):
        version += ".0"
    return licence % version


def match(found: list[tuple[str, str | None]]) -> tuple[list[str], list[str]]:
    """Licences in the order found, each once, and the identifiers that no rule takes. A copyright line in front of a licence belongs to it. Unknown sentences don't part the sentences of a licence."""
    licences: dict[str, None] = {}
    left, at = [f"UNKNOWN:{v}" for name, v in found if name == "UNKNOWN"], 0
    found = [x for x in found if x[0] != "UNKNOWN"]
    while at < len(found):
        for licence, default, sequence in RULES:
            k = at
            for part in ("COPYRIGHT?", *sequence):
                if k < len(found) and found[k][0] == part.rstrip("?"):
                    k += 1
                elif not part.endswith("?"):
                    k = -1
                    break
            if k > at:
                licences[_version(licence, default, next((v for _, v in found[at:k] if v), None))] = None
                at = k
                break
        else:
            left.append(found[at][0])
            at += 1
    return list(licences), left


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids, licenses and unmatched of every row."""
    bound_batches(docs.sparkSession)
    schema = "doc_id long, n_sentences long, sentence_ids array<string>, licenses array<string>, unmatched array<string>"

    def work(stream):
        for batch in stream:
            rows = []
            for text in batch.column("text").to_pylist():
                found = identify(text or "")
                known = [name for name, _ in found if name != "UNKNOWN"]
                rows.append((len(known), known, *match(found)))
            kinds = (pa.int64(), *[pa.list_(pa.string())] * 3)
            columns = [pa.array(x, k) for x, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_sentences", "sentence_ids", "licenses", "unmatched"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)


def digests(docs: DataFrame) -> DataFrame:
    """scan() with lists as strings, parted by a bar."""
    lists = ("sentence_ids", "licenses", "unmatched")
    return scan(docs).withColumns({c: F.array_join(c, "|") for c in lists})

import re

import pytest
from hypothesis import given, settings, strategies as st

from ledgerlark.llm import license_scan as L

MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files.
The above copyright notice and this permission notice shall be included in all copies or parts.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS be liable for any claim."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that:
* Redistributions of source code must retain the notice.
* Redistributions in binary form must reproduce the notice.
{}This software is provided by the authors "as is"."""


@pytest.mark.parametrize(
    "text, want",
    [
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("word\nThis work is licensed under the GNU General Public License, version 3.\nword", ["GPL-3.0-only"]),
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Released under the MIT Licence.", ["MIT"]),
        (MIT, ["MIT"]),
        (BSD.format("Neither the name of X may be used to endorse or promote products.\n"), ["BSD-3-Clause"]),
        (BSD.format(""), ["BSD-2-Clause"]),
        ("Distributed under the terms of the GNU General Public License, version 2; Either version 2 of the License, or (at your option) any later version.", ["GPL-2.0-or-later"]),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT OR Apache-2.0"]),
        ("Copyright (c) 2020 X. All rights reserved.", ["proprietary"]),
        ("Released under the MIT License.\nx\nReleased under the MIT License.\nLicensed under CC BY-SA 3.0.", ["MIT", "CC-BY-SA-3.0"]),
        ("He lost his driving licence. Permission was not given.", []),
        ("", []),
    ],
)
def test_rules(text, want):
    assert L.match(L.identify(text))[0] == want


def test_what_no_rule_takes():
    assert L.match(L.identify("Copyright (c) 1999 Someone\nThe software is provided as is.")) == ([], ["COPYRIGHT", "AS_IS"])


def test_rows(spark):
    rows = [(1, "a\nReleased under the MIT License.\nb", [1]), (1, None, [2]), (None, "Licensed under CC BY 4.0.", None), (2, "w " * 200_000 + "\nLicensed under the Apache License, Version 2.0.", [3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, licenses array<int>")
    got = sorted(((x.doc_id or 0, x.n_sentences, x.licenses) for x in L.digests(docs).collect()))
    assert got == [(0, 1, "CC-BY-4.0"), (1, 0, ""), (1, 1, "MIT"), (2, 1, "Apache-2.0")]
    assert L.digests(docs.limit(0)).collect() == []


GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM."""
TWO = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright
   notice.
2. Redistributions in binary form must reproduce the above copyright
   notice.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS WARRANTIES ARE DISCLAIMED."""
THREE = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU {}General Public License as published by
the Free Software Foundation, either version {} of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful.

You should have received a copy of the GNU {}General Public License
along with this program."""


@pytest.mark.parametrize("prefix", ["", " * ", "# ", "// "])
@pytest.mark.parametrize(
    "text, want",
    [
        ("MIT License\n\nCopyright (c) 2020 X\n\n" + GRANT, ["MIT"]),
        (TWO, ["BSD-2-Clause"]),
        (THREE.format("", "3", ""), ["GPL-3.0-or-later"]),
        (THREE.format("", "3", "").replace("\n", " "), ["GPL-3.0-or-later"]),
        (THREE.format("Lesser ", "2.1", "Lesser "), ["LGPL-2.1-or-later"]),
        (THREE.format("Affero ", "3", "Affero "), ["AGPL-3.0-or-later"]),
        ("it under the terms of the GNU General Public License as published by\nthe Free Software Foundation; version 3 of the License.", ["GPL-3.0-only"]),
        ("words of a text\nAll rights reserved\nmore words", ["proprietary"]),
        ("This file is in the public\ndomain.", ["public-domain"]),
    ],
)
def test_wrapped_lines(prefix, text, want):
    assert L.match(L.identify("\n".join(prefix + line for line in text.split("\n"))))[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ("The text was never in the public domain.", []),
        ("This work is not licensed under the MIT License.", []),
        ("It would be wrong to say that this is released under the Apache License, Version 2.0.", []),
        ("A sentence about the permission of the MIT institute.", []),
        ("Licensed under the MIT License - see the LICENSE file for details.", ["MIT"]),
        ('This file is licensed under the Apache License, Version 2.0 (the "License").', ["Apache-2.0"]),
        ("Licensed under GPLv3.", ["GPL-3.0-only"]),
        ("Released under the GPL-2.0+ license.", ["GPL-2.0-or-later"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.", ["MPL-2.0"]),
        ("Released under the 2-clause BSD license.", ["BSD-2-Clause"]),
        ("This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0"]),
        ("Available under CC0 1.0.", ["CC0-1.0"]),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice appears.", ["ISC"]),
    ],
)
def test_sentences(text, want):
    assert L.match(L.identify(text))[0] == want


def slow_match(found):
    """Rules by trying, for every place and rule, every choice of the sentences that may be missing."""
    from itertools import product

    names, out, left, at = [x for x, _ in found], [], [], 0
    while at < len(found):
        best = None
        for licence, default, sequence in L.RULES:
            choices = product(*[(True,) if not s.endswith("?") else (True, False) for s in sequence])
            taken = [len(want) for keep in choices if (want := [s.rstrip("?") for s, k in zip(sequence, keep) if k]) == names[at : at + len(want)]]
            if taken:
                best = (licence, default, max(taken))
                break
        if best is None:
            left.append(names[at])
            at += 1
            continue
        name = L._version(best[0], best[1], next((v for _, v in found[at : at + best[2]] if v), None))
        out += [name] * (name not in out)
        at += best[2]
    return out, left


def test_matching_against_all_choices():
    import random

    r = random.Random(5)
    names = sorted({s.rstrip("?") for _, _, q in L.RULES for s in q} | {v for v in L.WHOLE.values()} | {v for v, _ in L.OPENINGS.values()})
    for _ in range(400):
        found = []
        for _ in range(r.randrange(0, 7)):
            if r.random() < 0.5:
                found += [(s.rstrip("?"), r.choice([None, "3", "2.1"])) for s in r.choice(L.RULES)[2] if not s.endswith("?") or r.random() < 0.5]
            else:
                found.append((r.choice(names), None))
        assert L.match(found) == slow_match(found)


def test_look_ups_against_all_openings():
    for opening, (name, further) in L.OPENINGS.items():
        text = f"{opening} {further} x"
        # every opening by trying all of them
        want = max((k for k in L.OPENINGS if f"{text} ".startswith(f"{k} ")), key=len)
        known = L._known(text if name != "ISC_GRANT" else text + " notice")
        assert known == [(L.OPENINGS[want][0], None)] and L.OPENINGS[want][0] == name
    assert L._known("we say: " + next(iter(L.OPENINGS))) == []


STATED = {
    "Released under MIT.": ["MIT"],
    "This is licensed under the MIT License unless otherwise noted.": ["MIT"],
    "This project is dual-licensed under the MIT License or the Apache License 2.0, at your option.": ["MIT", "Apache-2.0"],
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option.": ["Apache-2.0", "MIT"],
    "Content is available under CC BY-SA 3.0 unless otherwise noted.": ["CC-BY-SA-3.0"],
    "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution.": ["EPL-2.0"],
    "Licensed under the zlib license.": ["Zlib"],
    "Licensed under MIT, Apache-2.0 or GPL-3.0-or-later.": ["MIT", "Apache-2.0", "GPL-3.0-or-later"],
    "It is available under the MIT and BSD licenses.": ["MIT", "BSD-3-Clause"],
    "This font software is licensed under the SIL Open Font License, Version 1.1.": ["OFL-1.1"],
    "Copyright (c) 2019 A. Person\n" + MIT: ["MIT"],
    "Copyright 2019 A. Person\nSPDX-License-Identifier: EPL-2.0": ["EPL-2.0"],
}


@pytest.mark.parametrize("text", STATED)
def test_ordinary_statements(text):
    assert L.match(L.identify(text)) == (STATED[text], [])


@pytest.mark.parametrize("text", ["This software is licensed under the terms of the Frobnicate licence.", "It is not licensed under MIT.", "Nothing here is licensed under the MIT License.", "SPDX-License-Identifier: (MIT", "The file was licensed under the MIT License.", "Whether it is licensed under the MIT License is unclear."])
def test_unknown_sentences_are_reported(text):
    licences, left = L.match(L.identify(text))
    assert licences == [] and len(left) == 1 and left[0].startswith("UNKNOWN:")
    assert L.match(L.identify(f"Some words.\n\n{text}\n\nReleased under the MIT License.")) == (["MIT"], left)


@pytest.mark.parametrize("text", ["", "Distributed under the trees they sat. The permission came late.", "A licensee? Not here."])
def test_other_sentences_are_not(text):
    assert [x for x in L.match(L.identify(text))[0]] == [] and not [x for x in L.identify(text) if x[0] != "UNKNOWN"]


@pytest.mark.parametrize("text, want", [("mit", "MIT"), ("(mit OR apache-2.0) and bsd-3-clause", "(MIT OR Apache-2.0) AND BSD-3-Clause"), ("MIT or (Apache-2.0 AND ISC)", "MIT OR Apache-2.0 AND ISC"), ("((MIT))", "MIT"), ("GPL-2.0-ONLY with linux-syscall-note", "GPL-2.0-only WITH Linux-syscall-note"), ("lgpl-2.1+", "LGPL-2.1+"), ("LicenseRef-Own", "LicenseRef-Own"), ("MIT OR", None), ("MIT AND OR ISC", None), ("(MIT", None), ("MIT ISC", None), ("MIT WITH", None), (")", None), ("", None), ("MIT/ISC", None)])
def test_expressions(text, want):
    assert L.expression(text) == want


NAMES = ["MIT", "Apache-2.0", "ISC", "Zlib", "GPL-2.0-only"]
TREES = st.recursive(st.sampled_from(NAMES), lambda inner: st.tuples(st.sampled_from(["AND", "OR"]), st.lists(inner, min_size=2, max_size=3)), max_leaves=8)


def written(tree, r):
    if isinstance(tree, str):
        return r.choice([tree, tree.lower(), f"({tree})"])
    return "(" + f" {r.choice([tree[0], tree[0].lower()])} ".join(written(x, r) for x in tree[1]) + ")"


def truth(tree, have):
    return tree in have if isinstance(tree, str) else (all if tree[0] == "AND" else any)(truth(x, have) for x in tree[1])


def meaning(text, have):
    """What Python makes of it: its `and` binds closer than its `or`, too."""
    return eval(re.sub(r"[A-Za-z][\w.-]*", lambda m: m[0].lower() if m[0] in ("AND", "OR") else str(m[0] in have), text))  # noqa: S307


@settings(max_examples=150, deadline=None)
@given(TREES, st.randoms())
def test_expressions_mean_what_they_were(tree, r):
    text = L.expression(written(tree, r))
    for k in range(1 << len(NAMES)):
        have = {n for j, n in enumerate(NAMES) if k >> j & 1}
        assert meaning(text, have) == truth(tree, have)
    assert L.expression(text) == text


def brute_match(found):
    """Every rule written out with and without each of its optional sentences; the first rule with one that fits takes the longest."""
    found = [x for x in found if x[0] != "UNKNOWN"]
    out, at = {}, 0
    left = []
    while at < len(found):
        for licence, default, sequence in L.RULES:
            forms = [[]]
            for part in ("COPYRIGHT?", *sequence):
                forms = [f + [part.rstrip("?")] for f in forms] + ([f for f in forms] if part.endswith("?") else [])
            fits = [f for f in forms if f and [x for x, _ in found[at : at + len(f)]] == f]
            if fits:
                n = len(max(fits, key=len))
                out[L._version(licence, default, next((v for _, v in found[at : at + n] if v), None))] = None
                at += n
                break
        else:
            left.append(found[at][0])
            at += 1
    return list(out), left


ALL = sorted({p.rstrip("?") for _, _, s in L.RULES for p in s} | {"COPYRIGHT", "GPL_COPY", "AS_IS", "LIABLE", "LATER"})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ALL).map(lambda x: [x]), st.sampled_from([[p.rstrip("?") for p in s] for _, _, s in L.RULES])), max_size=8))
def test_rules_against_all_forms(parts):
    found = [(x, None) for p in parts for x in p]
    assert L.match(found) == brute_match(found)

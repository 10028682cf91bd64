"""Licence scans by sentence rules: normalised sentences are mapped to identifiers of known licence sentences, and the
sequence of identifiers of a text is matched against ordered rules.

A text is cut at line ends and after sentence marks; a known sentence is found where it begins and ends at such cuts, however
many of them lie within it, so that wrapped and commented texts are read like unwrapped ones. Both tables are short and
fixed; only texts with a word that every known sentence needs go to Python.
"""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty


def _each(pattern: str, **names) -> tuple[str, ...]:
    """All readings of a pattern: {name} stands for each of the name's texts, [..] is there or not."""
    out = [pattern]
    for name, texts in names.items():
        out = [x.replace("{" + name + "}", t) for x in out for t in texts]
    while any("[" in x for x in out):
        out = [y for x in out for y in ([re.sub(r"\[([^\[\]]*)\]", r"\1", x, count=1), re.sub(r"\[[^\[\]]*\]", "", x, count=1)] if "[" in x else [x])]
    return tuple(dict.fromkeys(" ".join(x.split()) for x in out))


_UNDER = ("licensed", "released", "distributed", "available", "this work is licensed", "this project is licensed", "this project is released", "this software is licensed", "this software is released", "this program is licensed", "this file is licensed", "this code is licensed")
_TAILS = ("", "see the license file for details", "see license for details", "see the license md file for details", "see license md for details")


def _short(names: tuple[str, ...], *spdx: str) -> tuple[str, ...]:
    """Sentences that give a licence by name, and its SPDX lines."""
    return _each("{under} under [the] {name} {tail}", under=_UNDER, name=names, tail=_TAILS) + tuple(f"spdx license identifier {x}" for x in spdx)


def _free(kind: str, version: str, later: bool) -> tuple[str, ...]:
    """Notices of the GNU licences."""
    end = "[either] version {v} [of the license] or at your option any later version" if later else "version {v} [of the license] [only]"
    return _each("* is free software you can redistribute it and or modify it under the terms of [version {v} of] the gnu {kind} general public license as published by the free software foundation " + end, v=(version,), kind=(kind,))


def _gnu(kind: str, v: str, abbreviation: str) -> tuple[str, ...]:
    long = f"gnu {kind} general public license".replace("  ", " ")
    whole = (v.removesuffix(" 0"),)
    return _each("[gnu] {a} [v] {v}", a=(abbreviation,), v=(v, *whole)) + _each("[gnu] {a}v{v}", a=(abbreviation,), v=(v, *whole)) + tuple(f"{long} {w}{x}" for w in ("version ", "v", "v ") for x in dict.fromkeys((v, *whole)))


def _later(names: tuple[str, ...], *spdx: str) -> tuple[str, ...]:
    return _short(tuple(f"{x} or {y}" for x in names for y in ("later", "any later version", "at your option any later version")), *spdx)


def _creative(parts: str, v: str) -> tuple[str, ...]:
    full = {"by": "attribution", "sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
    name = " ".join(full[x] for x in parts.split())
    names = {name, name.replace("sharealike", "share alike"), name.replace("noncommercial", "non commercial"), name.replace("noderivatives", "noderivs"), name.replace("sharealike", "share alike").replace("noncommercial", "non commercial")}
    port = "international" if v == "4 0" else "unported"
    return (
        _each("{under} under [the] cc {parts} {v} [license]", under=_UNDER, parts=(parts,), v=(v,))
        + _each("{under} under {the} creative commons {name} {v} {port} license", under=_UNDER, the=("", "a", "the", "the terms of the"), name=tuple(sorted(names)), v=(v,), port=("", port, f"{port} public"))
        + (f"{name} {v} {port}", f"creative commons {name} {v} {port}", f"creative commons {name} {v} {port} public license", f"creative commons legal code {name} {v} {port}", f"spdx license identifier cc {parts} {v}")
    )


_DISCLAIMS = "the implied warranties of merchantability and fitness for a particular purpose"
# Known sentences as they read in lower case, with all but letters and digits as one blank. A star stands for
# up to WILD words, as names of holders do.
SENTENCES = {
    "mit_short": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "spdx license identifier mit", *_short(("mit license", "mit", "expat license", "mit license mit"), "expat")),
    "mit_title": ("mit license", "the mit license", "the mit license mit", "mit license mit", "license mit", "license mit license"),
    "mit_grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    "mit0_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    "as_is": (
        "the software is provided as is without warranty of any kind express or implied",
        *_each("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and {n}", n=("noninfringement", "non infringement", "nonifringement")),
    ),
    "mit_liable": _each("in no event shall {who} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software", who=("the authors or copyright holders", "*")),
    "apache_short": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "spdx license identifier apache 2 0", *_short(("apache license version 2 0", "apache license version 2 0 the license", "apache license 2 0", "apache license v2 0", "apache 2 0 license", "apache 2 0", "apache 2 license")), *_each("* licenses this file [to you] under the apache license version 2 0 [the license]")),
    "apache_title": ("apache license version 2 0 january 2004", "apache license version 2 0", "apache license version 2 0 january 2004 http www apache org licenses", "apache license version 2 0 january 2004 https www apache org licenses"),
    "apache_use": ("you may not use this file except in compliance with the license", "you may not use this project except in compliance with the license", "you may not use these files except in compliance with the license"),
    "apache_copy": _each("you may obtain a copy of the license at [{http} www apache org licenses license 2 0 [{end}]]", http=("http", "https"), end=("html", "txt")),
    "apache_basis": _each("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind [either express or implied]"),
    "apache_see": ("see the license for the specific language governing permissions and limitations under the license",),
    "gpl3_short": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0", *_short(_gnu("", "3 0", "gpl"))),
    "gpl3_later": _later(_gnu("", "3 0", "gpl"), "gpl 3 0 or later"),
    "gpl2_short": _short(_gnu("", "2 0", "gpl"), "gpl 2 0 only", "gpl 2 0"),
    "gpl2_later": _later(_gnu("", "2 0", "gpl"), "gpl 2 0 or later"),
    "lgpl2_short": _short(_gnu("library", "2 0", "lgpl"), "lgpl 2 0 only", "lgpl 2 0"),
    "lgpl21_short": _short(_gnu("lesser", "2 1", "lgpl"), "lgpl 2 1 only", "lgpl 2 1"),
    "lgpl3_short": _short(_gnu("lesser", "3 0", "lgpl"), "lgpl 3 0 only", "lgpl 3 0"),
    "lgpl2_later": _later(_gnu("library", "2 0", "lgpl"), "lgpl 2 0 or later"),
    "lgpl21_later": _later(_gnu("lesser", "2 1", "lgpl"), "lgpl 2 1 or later"),
    "lgpl3_later": _later(_gnu("lesser", "3 0", "lgpl"), "lgpl 3 0 or later"),
    "agpl3_short": _short(_gnu("affero", "3 0", "agpl"), "agpl 3 0 only", "agpl 3 0"),
    "agpl3_later": _later(_gnu("affero", "3 0", "agpl"), "agpl 3 0 or later"),
    "gpl_free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", *_free("", "3", True)),
    "gpl3_only_free": _free("", "3", False),
    "gpl2_free": _free("", "2", True),
    "gpl2_only_free": _free("", "2", False),
    "lgpl2_free": _free("library", "2", True) + _free("lesser", "2", True),
    "lgpl21_free": _free("lesser", "2 1", True),
    "lgpl21_only_free": _free("lesser", "2 1", False),
    "lgpl3_free": _free("lesser", "3", True),
    "lgpl3_only_free": _free("lesser", "3", False),
    "agpl3_free": _free("affero", "3", True),
    "agpl3_only_free": _free("affero", "3", False),
    "gpl3_text": ("gnu general public license version 3 29 june 2007",),
    "gpl2_text": ("gnu general public license version 2 june 1991",),
    "lgpl2_text": ("gnu library general public license version 2 june 1991",),
    "lgpl21_text": ("gnu lesser general public license version 2 1 february 1999",),
    "lgpl3_text": ("gnu lesser general public license version 3 29 june 2007",),
    "agpl3_text": ("gnu affero general public license version 3 19 november 2007",),
    "gpl_hope": ("this program is distributed in the hope that it will be useful but without any warranty", "* is distributed in the hope that it will be useful but without any warranty", "* is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    "gpl_implied": ("without even the implied warranty of merchantability or fitness for a particular purpose",),
    "gpl_see": _each("see the gnu {kind} general public license for more details", kind=("", "lesser", "library", "affero")),
    "mpl2": ("this source code form is subject to the terms of the mozilla public license v 2 0", "spdx license identifier mpl 2 0", *_short(("mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v2 0", "mozilla public license v 2 0", "mpl 2 0"))),
    "mpl2_title": ("mozilla public license version 2 0",),
    "mpl_copy": _each("if a copy of the mpl was not distributed with this file you can obtain one at [{http} mozilla org mpl 2 0]", http=("http", "https", "http www", "https www")),
    "isc_grant": tuple(f"permission to use copy modify {x} distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies" for x in ("and", "and or")),
    "0bsd_grant": tuple(f"permission to use copy modify {x} distribute this software for any purpose with or without fee is hereby granted" for x in ("and", "and or")),
    "isc_disclaim": ("the software is provided as is and * disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", "the software is provided as is and * disclaim all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    "isc_short": _short(("isc license", "isc"), "isc"),
    "isc_title": ("isc license", "the isc license", "isc license isc"),
    "0bsd_short": _short(("0bsd license", "0bsd", "zero clause bsd license"), "0bsd"),
    "bsd_redistribute": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use of this software in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    "bsd_source": _each("redistributions of source code must retain the [above] copyright notice this list of conditions and the following disclaimer"),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_advertise": _each("all advertising materials mentioning features or use of this software must display the following acknowledgement [this product includes software developed by *]"),
    "bsd_endorse": _each("neither the {name} of * nor the names of {its} contributors may be used to endorse or promote products derived from this software without [specific] prior written permission", name=("name", "names"), its=("its", "their", "any", "other", "the")) + ("the name of * may not be used to endorse or promote products derived from this software without specific prior written permission", "the names of * may not be used to endorse or promote products derived from this software without specific prior written permission", "neither the name of * may be used to endorse or promote products derived from this software without specific prior written permission"),
    "bsd_disclaim": _each(f"this software is provided by * as is and any express or implied warranties including but not limited to {_DISCLAIMS} are disclaimed"),
    "bsd_liable": ("in no event shall * be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",),
    "bsd2_short": _short(("bsd 2 clause license", "bsd 2 clause", "2 clause bsd license", "simplified bsd license", "bsd 2 clause simplified license"), "bsd 2 clause"),
    "bsd3_short": _short(("bsd 3 clause license", "bsd 3 clause", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause new or revised license"), "bsd 3 clause"),
    "bsd4_short": _short(("bsd 4 clause license", "bsd 4 clause", "4 clause bsd license"), "bsd 4 clause"),
    "bsd_short": _short(("bsd license", "bsd style license")),
    "unlicense": ("this is free and unencumbered software released into the public domain", *_short(("unlicense", "unlicense license"), "unlicense")),
    "unlicense_free": ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",),
    "cc0": (*_short(("cc0 1 0", "cc0", "cc0 1 0 license", "cc0 1 0 universal license", "cc0 license", "creative commons cc0 1 0 universal", "creative commons cc0 1 0 license", "creative commons zero v1 0 universal license", "creative commons cc0 1 0 universal public domain dedication"), "cc0 1 0"), "cc0 1 0 universal", "creative commons legal code cc0 1 0 universal", "to the extent possible under law * has waived all copyright and related or neighboring rights to *", "to the extent possible under law * have waived all copyright and related or neighboring rights to *", "to the extent possible under law * has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide", "to the extent possible under law * have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    "cc_by_nc_4": ("licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", *_creative("by nc", "4 0")),
    "cc_by_4": ("licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", *_creative("by", "4 0")),
    "cc_by_sa_4": _creative("by sa", "4 0"),
    "cc_by_nd_4": _creative("by nd", "4 0"),
    "cc_by_nc_sa_4": _creative("by nc sa", "4 0"),
    "cc_by_nc_nd_4": _creative("by nc nd", "4 0"),
    "cc_by_3": _creative("by", "3 0"),
    "cc_by_sa_3": _creative("by sa", "3 0"),
    "cc_by_nc_3": _creative("by nc", "3 0"),
    "cc_by_nd_3": _creative("by nd", "3 0"),
    "cc_by_nc_sa_3": _creative("by nc sa", "3 0"),
    "cc_by_nc_nd_3": _creative("by nc nd", "3 0"),
    "rights": ("all rights reserved",),
}
# Rules in order. A sequence may have up to GAP other sentences between two of its own. A rule's sentences
# are taken out of the text before later rules are tried, so that the longer ones come first.
RULES = (
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("Apache-2.0", ("apache_short", "apache_use", "apache_copy")),
    ("Apache-2.0", ("apache_short", "apache_use")),
    ("GPL-3.0-or-later", ("gpl_free", "gpl_hope")),
    ("GPL-3.0-or-later", ("gpl_free",)),
    ("MIT", ("mit_short",)),
    ("MIT", ("mit_grant",)),
    ("Apache-2.0", ("apache_short",)),
    ("Apache-2.0", ("apache_use",)),
    ("GPL-3.0", ("gpl3_short",)),
    ("CC-BY-NC-4.0", ("cc_by_nc_4",)),
    ("CC-BY-4.0", ("cc_by_4",)),
    ("BSD-4-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary", "bsd_advertise")),
    ("BSD-4-Clause", ("bsd_redistribute", "bsd_binary", "bsd_advertise")),
    ("BSD-3-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary", "bsd_endorse")),
    ("BSD-3-Clause", ("bsd_redistribute", "bsd_binary", "bsd_endorse")),
    ("BSD-2-Clause", ("bsd_redistribute", "bsd_source", "bsd_binary")),
    ("BSD-2-Clause", ("bsd_redistribute", "bsd_binary")),
    ("BSD", ("bsd_redistribute",)),
    ("All-rights-reserved", ("rights",)),
    ("MIT-0", ("mit0_grant",)),
    ("MIT", ("mit_title",)),
    ("Apache-2.0", ("apache_title",)),
    ("Apache-2.0", ("apache_basis",)),
    ("ISC", ("isc_grant",)),
    ("0BSD", ("0bsd_grant",)),
    *((name, (x,)) for name, ids in {
        "GPL-2.0": ("gpl2_short", "gpl2_only_free", "gpl2_text"),
        "GPL-2.0-or-later": ("gpl2_free", "gpl2_later"),
        "GPL-3.0": ("gpl3_only_free", "gpl3_text"),
        "GPL-3.0-or-later": ("gpl3_later",),
        "LGPL-2.0": ("lgpl2_short", "lgpl2_text"),
        "LGPL-2.0-or-later": ("lgpl2_free", "lgpl2_later"),
        "LGPL-2.1": ("lgpl21_short", "lgpl21_only_free", "lgpl21_text"),
        "LGPL-2.1-or-later": ("lgpl21_free", "lgpl21_later"),
        "LGPL-3.0": ("lgpl3_short", "lgpl3_only_free", "lgpl3_text"),
        "LGPL-3.0-or-later": ("lgpl3_free", "lgpl3_later"),
        "AGPL-3.0": ("agpl3_short", "agpl3_only_free", "agpl3_text"),
        "AGPL-3.0-or-later": ("agpl3_free", "agpl3_later"),
        "MPL-2.0": ("mpl2", "mpl2_title", "mpl_copy"),
        "ISC": ("isc_short", "isc_title"),
        "0BSD": ("0bsd_short",),
        "BSD-2-Clause": ("bsd2_short",),
        "BSD-3-Clause": ("bsd3_short",),
        "BSD-4-Clause": ("bsd4_short",),
        "BSD": ("bsd_short",),
        "Unlicense": ("unlicense", "unlicense_free"),
        "CC0-1.0": ("cc0",),
        **{f"CC-{p.upper().replace(' ', '-')}-{v}.0": (f"cc_{p.replace(' ', '_')}_{v}",) for v in "43" for p in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") if (p, v) not in (("by", "4"), ("by nc", "4"))},
    }.items() for x in ids),
)
GAP, WILD = 2, 12
#: Every known sentence has one of these words.
NEEDED = r"(?i)licen[sc]e|permission|copyright|warrant|redistribut|reserved|public[^a-z0-9]+domain|(?:released|distributed|available|published)[^a-z0-9]+under|liab|anyone[^a-z0-9]+is|advertis|cc0|attribution|mpl[^a-z0-9]+was"
#: Where a text is cut: at line ends and after sentence marks.
BREAKS = r"\r\n?|\n|(?<=[.!?;])[\x20\x09]+"

_WORD = re.compile(r"[^\W_]+")
_END = re.compile(r"[.!?;:][\s\W_]*\Z")
# Left out of a line: marks of comments that are letters, tags, and the number of an item, which is cut off from its text.
_REMARK = re.compile(r"\A[ \t]*(?:rem|dnl)(?=[ \t]|\Z)", re.I)
_TAG = re.compile(r"</?(?:p|br|pre|li|ul|ol|div|span|a|b|i|em|strong|code|blockquote|h[1-6])(?:\s[^<>]{0,200})?/?>", re.I)
_ITEM = re.compile(r"\A([\W_]*(?:\(?(?:[0-9]{1,2}|[ivx]{1,4}|[a-z])[.)]))[ \t]+", re.I)
_MARK = re.compile(r"\A(?:[0-9]{1,2}|[ivx]{1,4}|[a-z])\Z")
_SPDX = re.compile(r"(SPDX-License-Identifier[ \t]*:[ \t]*)([^\r\n]+)", re.I)
_CUT, _COLON = re.compile(BREAKS), re.compile(r"(?<=:)[ \t]+")


def _names() -> dict[str, str]:
    return {text: name for name, texts in SENTENCES.items() for text in texts}


@cache
def _tree() -> dict:
    """The known sentences by their words, a node for each beginning; "" has the name of what ends there."""
    root: dict = {}
    for text, name in _names().items():
        node = root
        for word in text.split():
            node = node.setdefault(word, {})
        node[""] = name
    return root


def _longest(node: dict, words: list[str], at: int, ends: set[int]) -> tuple[int, str]:
    """Where the longest known sentence from this node and word on ends, and its name; (0, "") without one."""
    best = (at, node[""]) if "" in node and at in ends else (0, "")
    if at < len(words):
        if words[at] in node:
            best = max(best, _longest(node[words[at]], words, at + 1, ends))
        if "*" in node:
            for n in range(1, min(WILD, len(words) - at) + 1):
                best = max(best, _longest(node["*"], words, at + n, ends))
    return best


def _cut(text: str) -> tuple[list[str], list[int], list[int], list[bool]]:
    """Words, and for each piece with words: the number of words before it, of sentences (as BREAKS cuts them) before it, and
    whether a sentence ends with it. Sentences are cut further after an item's number and after colons."""
    words: list[str] = []
    first: list[int] = []
    place: list[int] = []
    closed: list[bool] = []
    n = 0
    # an SPDX expression's licences as a line each; a plus is kept as words
    text = _SPDX.sub(lambda m: "\n".join(m[1] + x for x in re.split(r"\s+(?:OR|AND|or|and)\s+", m[2])), text)
    text = re.sub(r"(?<=[0-9])\+(?![\w+])", " or later", text)
    for line in re.split(r"\r\n?|\n", text):
        before = n
        for sentence in _CUT.split(_TAG.sub(" ", _REMARK.sub("", line))):
            item = _ITEM.match(sentence)
            pieces = [item[1], *_COLON.split(sentence[item.end() :])] if item else _COLON.split(sentence)
            held = len(words)
            for piece in pieces:
                own = _WORD.findall(piece.lower())
                if own:
                    first.append(len(words))
                    place.append(n)
                    words += own
                    closed.append(_END.search(piece) is not None)
            n += len(words) > held
        if n == before and closed:
            closed[-1] = True
    return words, first, place, closed


def scan(text: str | None) -> tuple[list[str], list[int], list[int]]:
    """Names of the known sentences of a text in order, their places (the number of sentences before each), and its rules."""
    if not text:
        return [], [], []
    words, first, place, closed = _cut(text)
    ends, piece_at = {*first[1:], len(words)}, {w: i for i, w in enumerate(first)}
    ids, places, marks = [], [], []
    i, open_ = 0, False  # open_: within a sentence that is not known
    tree = _tree()
    while i < len(first):
        end, name = _longest(tree, words, first[i], ends)
        if name:
            ids.append(name)
            places.append(place[i])
            marks.append(name)
            i, open_ = piece_at.get(end, len(first)), False
            continue
        if not open_ and not _MARK.match(" ".join(words[first[i] : first[i + 1] if i + 1 < len(first) else len(words)])):
            marks.append("-")
            open_ = True
        open_ = open_ and not closed[i]
        i += 1
    rules = []
    left = "," + ",,".join(marks) + "," if ids else ""
    for k, pattern in enumerate(_patterns()) if ids else ():
        if pattern.search(left):
            rules.append(k)
            left = pattern.sub(",*,", left)
    return ids, places, rules


@cache
def _patterns() -> list[re.Pattern]:
    between = f"(?:,-,|,[a-z0-9_]+,){{0,{GAP}}}"
    return [re.compile(between.join(f",{x}," for x in sequence)) for _, sequence in RULES]


def with_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with sentence_ids (array of the known sentences, in order), sentence_at (their places among the
    sentences), license_rules (number of each rule that holds) and licenses (sorted distinct licence names).

    Null and empty texts and texts without a known sentence have empty arrays. Rows are independent of each other. Columns of
    docs with one of these names are replaced, others stay whatever their names.
    """

    @F.pandas_udf("sentence_ids array<string>, sentence_at array<int>, license_rules array<int>")
    def found(texts):
        import pandas as pd

        return pd.DataFrame([scan(x) for x in texts], columns=["sentence_ids", "sentence_at", "license_rules"])

    source = text_or_empty(F.col(text))
    new = ("sentence_ids", "sentence_at", "license_rules")
    out = docs.select(F.struct("*").alias("row"), found(F.when(source.rlike(NEEDED), source)).alias("scan"))
    out = out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c not in (*new, "licenses")], *[f"scan.{c}" for c in new])
    names = F.array(*[F.lit(name) for name, _ in RULES])
    return out.withColumn("licenses", F.array_sort(F.array_distinct(F.transform("license_rules", lambda k: F.get(names, k)))))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """doc_id, licenses and sentence_ids (joined by blanks), n_sentences (known ones) and first_at (place of the first)."""
    out = with_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.array_join("licenses", " ").alias("licenses"),
        F.array_join("sentence_ids", " ").alias("sentence_ids"),
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.get("sentence_at", F.lit(0)).cast("long").alias("first_at"),
    )

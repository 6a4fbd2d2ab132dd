"""Licence recognition by sentences, with DataFrame expressions only.

A text is cut into sentences at line ends and behind ``. ! ? ; :`` before white space. A sentence is
normalised: every run of other characters than ASCII letters and digits becomes one space, A-Z are
lower-cased, ends are trimmed; sentences that are empty then don't count. Phrases that say that
something is under a licence are reduced to one form (``STATED``). Each sentence becomes the identifier
of the known licence sentence it equals, or 0, by a map. The sequence of identifiers is matched against
ordered licence rules, those of more sentences first; up to ``GAP`` unknown sentences may stand between
two of a rule, and a sentence belongs to one match.

Texts are read twice: as they are, every line an end, and as paragraphs: comment marks at the start of
lines are stripped, single line ends join lines, and enumerators (``1.``, ``(b)``) are dropped. Notices
that are wrapped, numbered or inside comments are recognised that way, and lines without a full stop the
other way. The licences of both count.

The known sentences are cut from the notices below by the same rules, or made from the names of licences.
``known`` takes further ones. Texts without any of the words ``MARKS`` are not looked up at all; sentences of
notices that have none of them either are no known ones.

All of it is a projection of one row: nothing is shuffled or joined, and no task depends on another.
A null or empty text has no sentences and no licences. Repeated rows each get their row, an empty
table gives none, and further columns are ignored.
"""

from __future__ import annotations

import re
import string
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Unknown sentences that may stand between two of a rule.
GAP = 3
#: Maps that known sentences are dealt to, by their lengths.
MAPS = 64

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
_GNU_OLD = "This {it} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation; either version {v} of the License, or (at your option) any later version."
_GNU_ONLY = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation, version {v}."

# Licences and what states them, sentence by sentence in this order.
NOTICES = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT-0", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-4-Clause", _BSD + " All advertising materials mentioning features or use of this software must display the following acknowledgement:"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004. TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE."),
    ("GPL-3.0-or-later", _GNU.format(name="", v="3")),
    ("GPL-3.0-or-later", _GNU_OLD.format(it="program", name="", v="3")),
    ("GPL-2.0-or-later", _GNU.format(name="", v="2")),
    ("GPL-2.0-or-later", _GNU_OLD.format(it="program", name="", v="2")),
    ("GPL-2.0-only", _GNU_ONLY.format(name="", v="2")),
    ("GPL-3.0-only", _GNU_ONLY.format(name="", v="3")),
    ("AGPL-3.0-or-later", _GNU.format(name="Affero", v="3")),
    ("AGPL-3.0-only", _GNU_ONLY.format(name="Affero", v="3")),
    ("LGPL-3.0-or-later", _GNU.format(name="Lesser", v="3")),
    ("LGPL-2.1-or-later", _GNU_OLD.format(it="library", name="Lesser", v="2.1")),
    ("LGPL-2.1-or-later", _GNU_OLD.format(it="program", name="Lesser", v="2.1")),
    ("LGPL-2.0-or-later", _GNU_OLD.format(it="library", name="Library", v="2")),
    ("Proprietary", "All rights reserved."),
    ("Proprietary", "Unauthorized copying of this file, via any medium is strictly prohibited."),
]

# Sentences that belong to licences without telling which.
SHARED = [
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
]

# Licences and the names by which statements and tags call them, in normalised form.
NAMES = {
    "MIT": ["mit license", "mit", "expat license"],
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache license v2 0"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause"],
    "ISC": ["isc license", "isc"],
    "GPL-2.0-only": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl v2", "gpl v2", "gplv2", "gpl 2 0", "gpl 2 0 only"],
    "GPL-2.0-or-later": ["gpl 2 0 or later", "gnu general public license version 2 or later", "gnu general public license version 2 or any later version"],
    "GPL-3.0-only": ["gnu general public license version 3", "gnu general public license v3", "gnu general public license v3 0", "gnu gpl v3", "gpl v3", "gplv3", "gpl 3 0", "gpl 3 0 only"],
    "GPL-3.0-or-later": ["gpl 3 0 or later", "gnu general public license version 3 or later", "gnu general public license version 3 or any later version"],
    "LGPL-2.1-only": ["gnu lesser general public license version 2 1", "lgpl v2 1", "lgpl 2 1", "lgpl 2 1 only"],
    "LGPL-2.1-or-later": ["lgpl 2 1 or later", "gnu lesser general public license version 2 1 or later"],
    "LGPL-3.0-only": ["gnu lesser general public license version 3", "lgpl v3", "lgplv3", "lgpl 3 0", "lgpl 3 0 only"],
    "LGPL-3.0-or-later": ["lgpl 3 0 or later"],
    "AGPL-3.0-only": ["gnu affero general public license version 3", "agpl v3", "agplv3", "agpl 3 0", "agpl 3 0 only"],
    "AGPL-3.0-or-later": ["agpl 3 0 or later"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v2 0", "epl 2 0"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "bsl 1 0"],
    "Zlib": ["zlib license", "zlib"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0", "cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-SA-3.0": ["cc by sa 3 0", "creative commons attribution sharealike 3 0 unported license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"],
    "Artistic-2.0": ["artistic license 2 0", "artistic 2 0"],
    "WTFPL": ["wtfpl"],
}

#: Normalised beginnings that say that something is under a licence; what follows is the licence's name.
STATED = (
    "^(?:(?:this|the|all|our) (?:[a-z0-9]+ ){1,4}(?:is|are) )?(?:dual )?(?:licensed|released|distributed|made available|available|provided|published|covered|shared)"
    " (?:under|by) (?:the )?(?:(?:terms|conditions) (?:and conditions )?of )?(?:the |a )?"
)
#: What stands before a licence identifier in source files.
TAG = "SPDX-License-Identifier"
#: What a lower-cased text that has a known sentence contains.
MARKS = (
    "licen|permission|redistribut|copyright|domain|spdx|reserved|warrant|liable|unauthorized"
    "|(?:released|distributed|available|provided|published|covered|shared)[^a-z0-9]+(?:under|by)"
)
_COMMENT = r"(^|\n)[ \t]*(?:(?://|/\*|\*|#|;|--|%|!|>|<!--|rem |dnl )[/*#;!%-]*)?[ \t]*"
_ENUMERATOR = "^(?:[0-9]{1,2}|[a-hivx]{1,3})$"


def cut(text: str) -> list[str]:
    """Normalised sentences of a line of text, as ``sentences`` cuts them."""
    out = [re.sub("[^A-Za-z0-9]+", " ", s).strip().lower() for s in re.sub(r"([.!?;:])[ \t\r]+", "\\1\n", text).split("\n")]
    return [re.sub(STATED, "licensed under ", s) for s in out if s]


@lru_cache(maxsize=4)
def known(more: tuple[tuple[str, str], ...] = ()) -> tuple[dict[str, int], list[tuple[str, tuple[int, ...]]]]:
    """Identifiers of known sentences, from 1 on, and rules: licence and identifiers in order. ``more``
    are further (licence, notice) pairs."""
    ids: dict[str, int] = {}
    rules = []
    for licence, notice in (*NOTICES, *more):
        found = tuple(ids.setdefault(s, len(ids) + 1) for s in cut(notice) if re.search(MARKS, s))
        if found and (licence, found) not in rules:
            rules.append((licence, found))
    for notice in SHARED:
        for s in cut(notice):
            if re.search(MARKS, s):
                ids.setdefault(s, len(ids) + 1)
    for licence, names in NAMES.items():
        tags = {" ".join(re.split("[^a-z0-9]+", licence.lower()))}
        for s in [*(f"licensed under {n}" for n in names), *(f"spdx license identifier {n}" for n in sorted({*names, *tags}))]:
            i = ids.setdefault(s, len(ids) + 1)
            if (licence, (i,)) not in rules:
                rules.append((licence, (i,)))
    return ids, sorted(rules, key=lambda r: -len(r[1]))


def _normal(text: Column, ends: str) -> Column:
    """Sentences of a text in which line feeds are ends; ``ends`` are the marks behind which one is."""
    cut_ = F.regexp_replace(text, ends, "$1\n")
    plain = F.trim(F.translate(F.regexp_replace(cut_, "[^A-Za-z0-9\n]+", " "), string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.transform(F.split(plain, " ?\n[ \n]*"), lambda s: F.trim(s)), lambda s: s != "")


def _untagged(text: Column) -> Column:
    """The colon of a licence tag ends no sentence."""
    return F.replace(text, F.lit(TAG + ":"), F.lit(TAG))


def sentences(text: Column) -> Column:
    """Normalised sentences of a text, every line end an end."""
    return _normal(_untagged(F.coalesce(text, F.lit(""))), r"([.!?;:])[ \t\r]+")


def paragraph_sentences(text: Column) -> Column:
    """Normalised sentences of a text's paragraphs."""
    bare = F.regexp_replace(F.replace(_untagged(text), F.lit("\r"), F.lit("")), _COMMENT, "$1")
    joined = F.regexp_replace(F.regexp_replace(bare, r"\n{2,}", ".\t"), "\n", " ")
    return F.filter(_normal(joined, r"([.!?;:])[\"')]*[ \t]+"), lambda s: ~F.rlike(s, F.lit(_ENUMERATOR)))


def _identified(found: Column, ids: dict[str, int]) -> Column:
    """Identifiers of sentences, 0 for unknown ones."""
    dealt: list[list[tuple[str, int]]] = [[] for _ in range(MAPS)]
    for s, i in ids.items():
        dealt[len(s) % MAPS].append((s, i))
    maps = F.array(*[F.create_map(*[F.lit(x) for pair in d or [("", 0)] for x in pair]) for d in dealt])

    def one(s: Column) -> Column:
        named = F.when(F.contains(s, F.lit(" under ")) | F.contains(s, F.lit(" by ")), F.regexp_replace(s, STATED, "licensed under ")).otherwise(s)
        return F.coalesce(F.element_at(F.get(maps, F.length(named) % MAPS), named), F.lit(0))

    return F.transform(found, one)


def rule_pattern(rule: tuple[int, ...]) -> str:
    """A rule as a pattern over identifiers in angle brackets."""
    return f"(?:<0>){{0,{GAP}}}".join(f"<{i}>" for i in rule)


def _matches(ids: Column, rules: list[tuple[str, tuple[int, ...]]]) -> Column:
    marks = F.concat(F.lit("<"), F.array_join(F.transform(ids, lambda i: i.cast("string")), "><"), F.lit(">"))
    for licence, rule in rules:
        if len(rule) > 1:
            marks = F.regexp_replace(marks, F.lit(rule_pattern(rule)), F.lit(f"[{licence}]"))
    alone = F.array(*[F.lit(x) for x in single_sentence(rules)])
    tokens = F.regexp_extract_all(marks, F.lit(r"\[[^\]]+\]|<[0-9]+>"), F.lit(0))
    inside = F.transform(tokens, lambda t: F.struct(t.alias("t"), F.substring(t, F.lit(2), F.length(t) - 2).alias("x")))
    named = F.transform(inside, lambda r: F.when(F.startswith(r["t"], F.lit("[")), r["x"]).otherwise(F.get(alone, r["x"].cast("int"))))
    return F.array_compact(named)


def single_sentence(rules: list[tuple[str, tuple[int, ...]]]) -> list[str | None]:
    """By identifier, from 0 on, the licence that a sentence states alone."""
    alone = {rule[0]: licence for licence, rule in reversed(rules) if len(rule) == 1}
    return [alone.get(i) for i in range(max(alone, default=0) + 1)]


def recognise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", more: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Per document: doc_id, n_sentences and sentence_ids (every line end an end), matches (each licence
    once, in textual order, those found in paragraphs alone behind the others)."""
    ids, rules = known(more)
    none, no_ids = F.array().cast("array<string>"), F.array().cast("array<int>")
    low = F.lower(F.col("text"))
    likely = F.coalesce(F.rlike(low, F.lit(MARKS)), F.lit(False))
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).select("doc_id", "text", sentences(F.col("text")).alias("s"), likely.alias("likely"))
    looked = found.select(
        "doc_id",
        F.size("s").cast("long").alias("n_sentences"),
        F.when(F.col("likely"), _identified(F.col("s"), ids)).otherwise(F.transform("s", lambda _: F.lit(0))).alias("sentence_ids"),
        F.when(F.col("likely"), _identified(paragraph_sentences(F.col("text")), ids)).otherwise(no_ids).alias("in_paragraphs"),
    )

    def licences(column: str) -> Column:
        # A document without known sentences, as most are, is not marked at all.
        return F.when(F.coalesce(F.array_max(column), F.lit(0)) > 0, _matches(F.col(column), rules)).otherwise(none)

    return looked.select("doc_id", "n_sentences", "sentence_ids", F.array_union(licences("sentence_ids"), licences("in_paragraphs")).alias("matches"))

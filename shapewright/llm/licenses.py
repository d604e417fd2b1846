"""License recognition by sentences and ordered rules.

A text is cut into sentences twice: line by line, and by paragraph, where lines
are joined, so that wrapped sentences are met whole; a line without a letter or
digit ends a paragraph, and marks of comments at a line's start don't count. A
sentence is normalised to lower-case letters and digits with single spaces. A
known sentence is the sequence of all the pieces that it falls into when it is
cut so, and is found where these stand one after the other; where two begin at
a piece, the longer one counts. A sentence may have one slot, ``{}``, for a
holder's name: up to ``MOST_SLOT`` words, which may be cut into ``MOST_PIECES``
pieces by stops in it. An SPDX line is cut into one for each licence of its
expression. The identifiers found, in their order, make the
text's sequence. A rule is an ordered sequence too, and matches where its
identifiers stand in this order, with or without others between; a rule whose
sequence is part of that of another one that matches isn't told.

Sentences and rules are tables of the caller's, or those of ``sentences`` and
``rules`` here. Both are arrays of buckets addressed by hash, so that a piece is
looked up at once, however many sentences there are. All by built-in functions,
text by text, without a shuffle: nothing is held but the two tables.

A null or empty text has no identifiers. Very long texts are read whole.
Repeated rows have a result each, and ties can't be: rules are reported in the
order of their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from itertools import permutations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of licence texts and headers, by the identifier that rules use.
#: A colon parts what stands on two lines where a text is cut line by line.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl-free": "This program is free software:",
    "gpl-free-old": "This program is free software;",
    "lgpl-free": "This library is free software;",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-names-of": "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-name": "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": "THIS SOFTWARE IS PROVIDED BY {} \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-grant-and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-disclaimer": "THE SOFTWARE IS PROVIDED \"AS IS\" AND {} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "apache-title": "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
    "apache-title-alone": "Apache License Version 2.0, January 2004",
    "apache-meaning": "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
    "apache-copyright": "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    "gpl-2-title": "GNU GENERAL PUBLIC LICENSE: Version 2, June 1991",
    "gpl-3-title": "GNU GENERAL PUBLIC LICENSE: Version 3, 29 June 2007",
    "lgpl-2.1-title": "GNU LESSER GENERAL PUBLIC LICENSE: Version 2.1, February 1999",
    "lgpl-3-title": "GNU LESSER GENERAL PUBLIC LICENSE: Version 3, 29 June 2007",
    "agpl-3-title": "GNU AFFERO GENERAL PUBLIC LICENSE: Version 3, 19 November 2007",
    "verbatim": "Everyone is permitted to copy and distribute verbatim copies: of this license document, but changing it is not allowed.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-dedicated": "This work is dedicated to the public domain under CC0 1.0.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
}

#: Rules over these sentences.
RULES = {
    "boost-1.0/text": ["boost-grant"],
    "bsd-2-clause/text": ["bsd-redistribution", "bsd-source", "bsd-binary"],
    "bsd-3-clause/text": ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names"],
    "bsd-3-clause/text-names-of": ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names-of"],
    "bsd-4-clause/text-names-of": ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names-of"],
    "bsd-3-clause/text-name": ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-name"],
    "bsd-4-clause/text": ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"],
    "cc0-1.0/line": ["cc0-dedicated"],
    "isc/text": ["isc-grant"],
    "isc/text-and": ["isc-grant-and", "isc-disclaimer"],
    "apache-2.0/text": ["apache-title", "apache-meaning", "apache-copyright"],
    "apache-2.0/text-alone": ["apache-title-alone", "apache-meaning", "apache-copyright"],
    "gpl-2.0/text": ["gpl-2-title", "verbatim"],
    "gpl-3.0/text": ["gpl-3-title", "verbatim"],
    "lgpl-2.1/text": ["lgpl-2.1-title", "verbatim"],
    "lgpl-3.0/text": ["lgpl-3-title", "verbatim"],
    "agpl-3.0/text": ["agpl-3-title", "verbatim"],
    "mit/text": ["mit-grant", "mit-notice", "as-is"],
    "unlicense/text": ["unlicense"],
    "zlib/text": ["zlib-grant"],
}

#: Names that licences are granted by, by identifier.
NAMES = {
    "mit": ["the MIT License", "MIT", "the MIT license"],
    "apache-1.1": ["the Apache License, Version 1.1"],
    "apache-2.0": ["the Apache License, Version 2.0", "Apache License 2.0", "the Apache License 2.0"],
    "bsd-2-clause": ["the BSD 2-Clause License"],
    "bsd-3-clause": ["the BSD 3-Clause License", "the New BSD License"],
    "isc": ["the ISC License"],
    "epl-1.0": ["the Eclipse Public License 1.0", "the Eclipse Public License, version 1.0"],
    "epl-2.0": ["the Eclipse Public License 2.0", "the Eclipse Public License, version 2.0"],
    "artistic-2.0": ["the Artistic License 2.0"],
    "unlicense": ["the Unlicense"],
    "zlib": ["the zlib License"],
    "boost-1.0": ["the Boost Software License, Version 1.0"],
}
#: How a line grants a licence.
GRANTS = ["Released under {}.", "Licensed under {}.", "This work is licensed under {}.", "Distributed under {}.", "This software is licensed under {}."]


#: Short names that dual grants use, and how such a line reads.
SHORT = {"mit": "MIT", "apache-2.0": "Apache-2.0", "bsd-3-clause": "BSD-3-Clause", "gpl-2.0": "GPL-2.0", "gpl-3.0": "GPL-3.0", "mpl-2.0": "MPL-2.0"}
DUAL = ["Dual-licensed under {} or {}.", "Dual-licensed under {} and {}.", "Licensed under either of {} or {}.", "Licensed under either {} or {} at your option.", "Dual licensed under the {} and {} licenses."]
#: Identifiers of the SPDX list that differ from ours in more than case.
SPDX = {"boost-1.0": "BSL-1.0"}
#: Words that a slot takes, and pieces that it and what is around it may be cut into.
MOST_SLOT, MOST_PIECES = 12, 4


def _by_name() -> dict[str, list[str]]:
    """NAMES with the families whose names follow a rule."""
    names = {k: list(v) for k, v in NAMES.items()}
    for version in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        for kind in ("BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"):
            names[f"cc-{kind.lower()}-{version}"] = [f"CC {kind} {version}", f"CC-{kind}-{version}", f"the Creative Commons {kind} {version} License"]
    for short, long, versions in (("gpl", "GNU General Public License", ("1", "2", "3")), ("lgpl", "GNU Lesser General Public License", ("2.1", "3")), ("agpl", "GNU Affero General Public License", ("3",))):
        for version in versions:
            full = version if "." in version else f"{version}.0"
            names[f"{short}-{full}"] = [f"the {long}, version {version}", f"the {long} version {version}", f"the {long} v{version}"]
    for version in ("1.0", "1.1", "2.0"):
        names[f"mpl-{version}"] = [f"the Mozilla Public License, v. {version}", f"the Mozilla Public License, version {version}", f"the Mozilla Public License {version}"]
    return names


#: Identifiers that only SPDX lines use.
RULES_BY_SPDX = ["cc0-1.0", "bsd-4-clause", *[f"{short}-{kind}" for short in ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0") for kind in ("only", "or-later")]]


def sentences() -> dict[str, str]:
    """The known sentences, by identifier."""
    made = dict(SENTENCES)
    for names in _by_name().values():
        for name in names:
            for grant in GRANTS:
                made[line_id(grant.format(name))] = grant.format(name)
    for (a, one), (b, two) in permutations(SHORT.items(), 2):
        for form in DUAL:
            made[line_id(form.format(one, two))] = form.format(one, two)
    for licence in (*_by_name(), *RULES_BY_SPDX):
        made[f"spdx-{licence}"] = f"SPDX-License-Identifier: {SPDX.get(licence, licence)}"
    for version in ("1.1", "2.0"):
        made[f"apache-{version}-header"] = f'Licensed under the Apache License, Version {version} (the "License");'
    for version in ("1.0", "1.1", "2.0"):
        made[f"mpl-{version}-form"] = f"This Source Code Form is subject to the terms of the Mozilla Public License, v. {version}."
    for short, long, versions in (("gpl", "GNU General Public License", ("1", "2", "3")), ("lgpl", "GNU Lesser General Public License", ("2.1", "3")), ("agpl", "GNU Affero General Public License", ("3",))):
        for version in versions:
            for mark, dash in ((",", "comma"), (";", "semicolon")):
                made[f"{short}-{version}-later-{dash}"] = f"you can redistribute it and/or modify it under the terms of the {long} as published by the Free Software Foundation{mark} either version {version} of the License, or (at your option) any later version."
                made[f"{short}-{version}-only-{dash}"] = f"you can redistribute it and/or modify it under the terms of the {long} as published by the Free Software Foundation{mark} version {version} of the License."
    return made


def rules() -> dict[str, list[str]]:
    """The rules, by licence and kind; each is a sequence of identifiers."""
    made = {k: list(v) for k, v in RULES.items()}
    for licence, names in _by_name().items():
        for sentence in (grant.format(name) for name in names for grant in GRANTS):
            made[f"{licence}/{line_id(sentence)}"] = [line_id(sentence)]
    for (a, one), (b, two) in permutations(SHORT.items(), 2):
        for sentence in (form.format(one, two) for form in DUAL):
            made |= {f"{licence}/{line_id(sentence)}": [line_id(sentence)] for licence in (a, b)}
    for licence in (*_by_name(), *RULES_BY_SPDX):
        made[f"{licence}/spdx"] = [f"spdx-{licence}"]
    for version in ("1.1", "2.0"):
        made[f"apache-{version}/header"] = [f"apache-{version}-header", "apache-use", "apache-copy"]
    for version in ("1.0", "1.1", "2.0"):
        made[f"mpl-{version}/header"] = [f"mpl-{version}-form"]
    for short, versions in (("gpl", ("1", "2", "3")), ("lgpl", ("2.1", "3")), ("agpl", ("3",))):
        for version in versions:
            full = version if "." in version else f"{version}.0"
            for kind, dash in (("later", "comma"), ("later", "semicolon"), ("only", "comma"), ("only", "semicolon")):
                told = f"{short}-{full}-{'or-later' if kind == 'later' else 'only'}"
                for opening, hope in (("gpl-free", "gpl-hope"), ("gpl-free-old", "gpl-hope"), ("lgpl-free", "lgpl-hope")):
                    made[f"{told}/header-{opening}-{dash}"] = [opening, f"{short}-{version}-{kind}-{dash}", hope]
    return made


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


def line_id(sentence: str) -> str:
    """The identifier of a sentence that is known by its words alone."""
    return normal(sentence).replace(" ", "-")


#: The stop of an abbreviated "version", which ends no sentence.
STOP = r"\b([Vv])\.\s+"
#: Ends of sentences: white space after a full stop, question mark, exclamation mark, colon or semicolon.
CUT = r"(?<=[.?!:;])\s+"
#: Marks of comments at a line's start.
MARKS = r"^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+)?[ \t]*"


def parts_of(sentence: str) -> list[str]:
    """The normalised pieces that a known sentence falls into when a text is cut."""
    return [p for p in map(normal, re.split(CUT, re.sub(STOP, r"\1 ", sentence))) if p]


def _bare(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def _words(text: str, count: int) -> str:
    return " ".join(text.split(" ")[:count])


class Table:
    """What is known by a text, in buckets addressed by the text's hash; the
    optimiser makes a constant of it, once."""

    def __init__(self, entries: Mapping[str, Sequence[Mapping]], kind: str):
        self.size = 1 << max(len(entries) * 2, 1).bit_length()
        buckets: list[list[dict]] = [[] for _ in range(self.size)]
        for key, values in entries.items():
            buckets[xxhash.xxh64_intdigest(key.encode(), 42) % self.size].append({"key": key, "values": list(values)})
        self.held = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<key:string,values:array<{kind}>>>>")

    def __getitem__(self, key: Column) -> Column:
        """The values of a key, null if there are none. The size is a power of two, so the sign of a hash says nothing."""
        bucket = F.get(self.held, F.xxhash64(key).bitwiseAND(F.lit(self.size - 1)).cast("int"))
        return F.get(F.filter(bucket, lambda e: e["key"] == key), F.lit(0))["values"]


def _let(value: Column, body) -> Column:  # noqa: ANN001
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Words by which a sentence with a slot is found.
OPENING = 3


def _spdx(unit: Column) -> Column:
    """The lines of an SPDX line's licences, or the unit itself."""
    tail = F.substring_index(unit, "SPDX-License-Identifier:", -1)
    each = F.filter(F.split(tail, r"(?i)\s+(?:or|and|with)\s+|[()]"), lambda t: F.trim(t) != "")
    return F.when(unit.contains("SPDX-License-Identifier:"), F.transform(each, lambda t: F.concat(F.lit("SPDX-License-Identifier: "), F.trim(t)))).otherwise(F.array(unit))


def _places(units: Column, known: Mapping[str, str]) -> Column:
    """(id, place) of the known sentences in an array of texts: each is cut into
    pieces, and a place is a piece's, from 1."""
    plain = {name: parts_of(sentence) for name, sentence in known.items() if "{}" not in sentence}
    first: dict[str, list[dict]] = {}
    for name, pieces in sorted(plain.items(), key=lambda x: (-len(x[1]), x[0])):
        first.setdefault(pieces[0], []).append({"name": name, "pieces": pieces})
    opening: dict[str, list[dict]] = {}
    for name, sentence in sorted(known.items()):
        if "{}" in sentence:
            before, after = map(normal, sentence.split("{}"))
            if len(before.split(" ")) < OPENING or not after:
                raise ValueError(f"{name}: a slot stands after {OPENING} words and before some")
            opening.setdefault(_words(before, OPENING), []).append({"name": name, "before": before + " ", "after": " " + after})
    exact, slotted = Table(first, "struct<name:string,pieces:array<string>>"), Table(opening, "struct<name:string,before:string,after:string>")
    openings = F.array(*[F.lit(k) for k in opening]) if opening else F.array().cast("array<string>")
    cut = lambda u: F.split(F.regexp_replace(u, STOP, "$1 "), CUT)
    pieces = F.filter(F.transform(F.flatten(F.transform(F.flatten(F.transform(units, _spdx)), cut)), _bare), lambda p: p != "")

    def found(all_: Column) -> Column:
        def filled(k: Column, c: Column) -> Column:
            """Whether the pieces from one on are a sentence with something in its slot."""

            def ends(n: int) -> Column:
                def good(text: Column) -> Column:
                    words = F.size(F.split(F.substring(text, F.length(c["before"]) + 1, F.length(text) - F.length(c["before"]) - F.length(c["after"])), " "))
                    return text.startswith(c["before"]) & text.endswith(c["after"]) & (F.length(text) > F.length(c["before"]) + F.length(c["after"])) & (words <= MOST_SLOT)

                return (k + n <= F.size(all_)) & _let(F.array_join(F.slice(all_, k + 1, n), " "), good)

            one = ends(1)
            for n in range(2, MOST_PIECES + 1):
                one = one | ends(n)
            return one

        def at(piece: Column, k: Column) -> Column:
            good = F.filter(exact[piece], lambda c: F.slice(all_, k + 1, F.size(c["pieces"])) == c["pieces"])
            name = F.get(good, F.lit(0))["name"]
            if opening:
                start = F.substring_index(piece, " ", OPENING)
                slots = F.when(F.array_contains(openings, start), F.filter(slotted[start], lambda c: filled(k, c)))
                name = F.coalesce(name, F.get(slots, F.lit(0))["name"])
            return F.struct(name.alias("id"), (k + 1).alias("place"))

        return F.filter(F.transform(all_, at), lambda x: x["id"].isNotNull())

    return _let(pieces, found)


def _within(small: Sequence[str], large: Sequence[str]) -> bool:
    at = iter(large)
    return all(x in at for x in small)


def _in_order(ids: Column, sequence: Column) -> Column:
    """Whether a sequence stands in an array of identifiers in its order, with or without others between."""
    met = F.aggregate(ids, F.lit(0), lambda n, i: n + F.coalesce(F.get(sequence, n) == i, F.lit(False)).cast("int"))
    return met == F.size(sequence)


def license_scan(docs: DataFrame, known: Mapping[str, str] | None = None, ordered: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``docs`` with sentence_places and paragraph_places (id and the number of
    its first piece, by lines and by paragraphs), sentence_ids and paragraph_ids
    (the identifiers alone) and licenses (rules that match either); clashing
    columns are replaced."""
    known, ordered = known or sentences(), dict(sorted((ordered or rules()).items()))
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, r"\n", -1)
    bare = F.regexp_replace(text, f"(?m){MARKS}", "")
    paragraphs = F.split(bare, r"\n(?:[^\p{L}\p{N}\n]*\n)+", -1)
    columns = ["sentence_places", "paragraph_places", "sentence_ids", "paragraph_ids", "licenses"]
    out = docs.drop(*columns).withColumns({"sentence_places": _places(lines, known), "paragraph_places": _places(paragraphs, known)})
    out = out.withColumns({"sentence_ids": F.transform("sentence_places", lambda x: x["id"]), "paragraph_ids": F.transform("paragraph_places", lambda x: x["id"])})
    # a text is held only against the rules that begin with an identifier that it has
    by_id: dict[str, list[str]] = {}
    for name, ids in ordered.items():
        for i in set(ids):
            by_id.setdefault(i, []).append(name)
    above = {name: [o for o in by_id[ids[0]] if len(ordered[o]) > len(ids) and _within(ids, ordered[o])] for name, ids in ordered.items()}
    first: dict[str, list[dict]] = {}
    for name, ids in ordered.items():
        first.setdefault(ids[0], []).append({"name": name, "ids": list(ids), "above": above[name]})
    table = Table(first, "struct<name:string,ids:array<string>,above:array<string>>")
    either = F.array_distinct(F.concat("sentence_ids", "paragraph_ids"))

    def most(all_: Column) -> Column:
        names = F.transform(all_, lambda r: r["name"])
        return F.array_sort(F.transform(F.filter(all_, lambda r: ~F.arrays_overlap(r["above"], names)), lambda r: r["name"]))

    def matching(ids: Column) -> Column:
        asked = F.flatten(F.filter(F.transform(ids["either"], lambda i: table[i]), lambda r: r.isNotNull()))
        return _let(F.filter(asked, lambda r: _in_order(ids["lined"], r["ids"]) | _in_order(ids["joined"], r["ids"])), most)

    met = _let(F.struct(either.alias("either"), F.col("sentence_ids").alias("lined"), F.col("paragraph_ids").alias("joined")), matching)
    return out.withColumn("licenses", F.when(F.size(either) == 0, F.array().cast("array<string>")).otherwise(met))

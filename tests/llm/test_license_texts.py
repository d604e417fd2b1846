"""Licences as their texts stand in real files: named holders, whole texts, SPDX lines, dual grants."""

import pytest

from shapewright.llm import licenses
from shapewright.llm.common import reach_workers

BSD = """Copyright 2008, Google Inc.
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are
met:

    * Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer.
    * Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the
distribution.
"""
NAMES = """    * Neither the name of Google Inc. nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS
"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR
A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
ISC = """/*
 * Copyright (c) 2004 Some One <one@example.org>
 *
 * Permission to use, copy, modify, and distribute this software for any
 * purpose with or without fee is hereby granted, provided that the above
 * copyright notice and this permission notice appear in all copies.
 *
 * THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
 * WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
 * MERCHANTABILITY AND FITNESS.
 */
"""
APACHE = """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   1. Definitions.

      "License" shall mean the terms and conditions for use, reproduction,
      and distribution as defined by Sections 1 through 9 of this document.

   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      copyright license to reproduce, prepare Derivative Works of,
      publicly display, publicly perform, sublicense, and distribute the
      Work and such Derivative Works in Source or Object form.
"""
TEXTS = {
    "bsd3": (BSD + NAMES + DISCLAIMER, {"bsd-3-clause"}),
    "bsd2": (BSD + DISCLAIMER, {"bsd-2-clause"}),
    "bsd3 by one": (BSD + NAMES.replace("Google Inc.", "the University of California, Berkeley"), {"bsd-3-clause"}),
    "bsd3 in a line": (BSD.replace("\n", " ").replace("  ", " ") + "\n" + NAMES.replace("\n", " "), {"bsd-3-clause"}),
    "bsd too long a name": (BSD + NAMES.replace("Google Inc.", "x " * 13), {"bsd-2-clause"}),
    "bsd no name": (BSD + NAMES.replace("of Google Inc. nor", "of nor"), {"bsd-2-clause"}),
    "isc": (ISC, {"isc"}),
    "apache": (APACHE, {"apache-2.0"}),
    "spdx": ("// SPDX-License-Identifier: MIT\nint x;", {"mit"}),
    "spdx expression": ("# SPDX-License-Identifier: (Apache-2.0 OR MIT) AND BSD-3-Clause\n", {"apache-2.0", "mit", "bsd-3-clause"}),
    "spdx later": ("/* SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0 */", {"gpl-2.0-or-later"}),
    "spdx boost": ("SPDX-License-Identifier: BSL-1.0", {"boost-1.0"}),
    "spdx unknown": ("SPDX-License-Identifier: NoSuch-9", set()),
    "dual": ("This crate is here. Licensed under either of MIT or Apache-2.0.\n", {"mit", "apache-2.0"}),
    "gpl": ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n", {"gpl-3.0"}),
    "title alone": ("see the Apache License, it says", set()),
}


def scanned(spark, rows, *tables):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return [r.licenses for r in licenses.license_scan(df, *tables).orderBy("doc_id").collect()]


def test_texts_of_real_files(spark):
    reach_workers(spark)
    got = scanned(spark, [t for t, _ in TEXTS.values()])
    assert {k: {x.split("/")[0] for x in g} for k, g in zip(TEXTS, got, strict=True)} == {k: want for k, (_, want) in TEXTS.items()}


def test_identifiers_are_no_patterns(spark):
    known = {"a_1": "First of all.", "ax1": "Second of all.", "%": "Third of all.", "<b>": "Fourth of all."}
    ordered = {"one": ["a_1", "ax1"], "all": ["%", "<b>"], "twice": ["a_1", "a_1"]}
    assert scanned(spark, ["Second of all.\nSecond of all.", "First of all.\nSecond of all.", "First of all.\nFourth of all.", "Third of all. Fourth of all.", "First of all. x. First of all.", "First of all."], known, ordered) == [[], ["one"], [], ["all"], ["twice"], []]


def test_many_sentences_cost_a_lookup_each(spark):
    known = {f"s{k}": f"sentence number {k} stands here." for k in range(20000)}
    ordered = {f"r{k}": [f"s{k}", f"s{k + 1}"] for k in range(0, 19999, 2)}
    got = scanned(spark, ["\n".join(f"sentence number {k} stands here." for k in (6, 7, 100, 102, 19998, 19999)), "none"] + [f"Sentence number {k} stands here!" for k in range(300)], known, ordered)
    assert got[0] == ["r19998", "r6"] and not any(got[1:])


def test_a_slot_needs_words_around_it(spark):
    with pytest.raises(ValueError, match="a slot stands"):
        licenses.license_scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {"s": "by {}"}, {"r": ["s"]})

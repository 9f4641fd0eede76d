"""Notices of families that share words, and a plain comparison with the templates."""

import re

import pytest

pytest.importorskip("decidra.llm")
from decidra.llm import license_scan  # noqa: E402

NOTICES = {
    "lgpl": [
        "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
        "You can modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License.", "// SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "gpl-2.0": ["You can redistribute it under the terms of the GNU General Public License\nas published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.", "# SPDX-License-Identifier: GPL-2.0-only"],
    "gpl-3.0": ["modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "agpl-3.0": ["modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License."],
    "apache-2.0": ["SPDX-License-Identifier: Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")."],
    "mit": ["SPDX-License-Identifier: MIT"],
    "bsd": ["* Redistributions of source code must retain the above copyright notice, this\n  list of conditions and the following disclaimer."],
    "zlib": ["This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}
CLEAN = ["The library was free, and the general public read version 2 of the story there.", "A licence to fish costs little; the terms are on the board.", "Warranty cards are in the box."]


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, t, f) for k, (f, t) in enumerate((f, t) for f, ts in NOTICES.items() for t in ts)]
    rows += [(100 + k, t, "") for k, t in enumerate(CLEAN)]
    got = license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    return {r.doc_id: r for r in got}, rows


def test_families_that_share_words(found):
    got, rows = found
    assert {i: got[i].licenses for i, _, _ in rows} == {i: f for i, _, f in rows}


def test_reported_families_hold_a_template(found):
    """Plain: at least 70 % of the word pairs of a template of the family are in the text."""
    got, rows = found
    pairs = lambda t: {(a, b) for w in [re.findall(r"[^\W_]+", t.lower())] for a, b in zip(w, w[1:])}
    for i, text, _ in rows:
        for family in filter(None, got[i].licenses.split(",")):
            assert any(len(pairs(t) & pairs(text)) >= 0.7 * len(pairs(t)) for t in license_scan.TEMPLATES[family])

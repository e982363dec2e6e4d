"""Values that are equal in any form get equal pseudonyms; the licence query against a plain version of it."""

import datetime
import re
from collections import Counter, defaultdict

from conftest import SF

from lutrin.llm import license_scan, pii, queries


def test_dates_link_in_all_forms():
    """Every fifth day of the range, in three forms: one permutation of the days, whatever the form, and back."""
    names = pii.Pseudonyms(b"key")
    seen = set()
    for n in range(pii.FIRST_DAY, pii.FIRST_DAY + pii.DAYS, 5):
        day = datetime.date.fromordinal(n)
        forms = [f"{day:%Y-%m-%d}", f"{day:%d/%m/%Y}", f"{day:%d.%m.%Y}"] + ([f"{day:%m/%d/%Y}"] if day.day > 12 else [])
        new = [names.replace(x) for x in forms]
        assert [k for _, k in new] == [["iso"], ["dmy"], ["dmy"], ["dmy"]][: len(forms)]
        y, m, d = map(int, new[0][0].split("-"))
        made = datetime.date(y, m, d)
        assert (made.day > 12) == (day.day > 12) and new[1][0] == f"{made:%d/%m/}{y:04d}" and new[2][0] == f"{made:%d.%m.}{y:04d}"
        assert len(new) < 4 or new[3][0] == f"{made:%m/%d/}{y:04d}"
        assert all(names.replace(x, inverse=True)[0] == f for (x, _), f in zip(new, forms, strict=True))
        seen.add(made)
    assert len(seen) == len(range(pii.FIRST_DAY, pii.FIRST_DAY + pii.DAYS, 5))


def test_phone_numbers_link_at_home_and_abroad():
    names = pii.Pseudonyms(b"key")
    digits = lambda x: re.sub("[^0-9]", "", x)
    for forms in (["+33 6 12 34 56 78", "+33612345678", "0033 6 12 34 56 78", "06 12 34 56 78", "06.12.34.56.78"], ["+49 30 12345678", "0049 30 1234 5678", "030 12345678", "030/12345678"], ["+1 555 123 4567", "555-123-4567", "(555) 123-4567"]):
        made = [names.replace(x) for x in forms]
        assert all(k == ["phone"] for _, k in made), forms
        assert len({digits(y)[-9:] for y, _ in made}) == 1 and all(y != x for (y, _), x in zip(made, forms, strict=True))
        assert [names.replace(y, inverse=True)[0] for y, _ in made] == forms
    for x in ("007", "00 12", "1906 12 34", "0.12 34 56 78 90", "room 06 12", "v00123456789"):
        assert names.replace(x) == (x, []), x


def test_small_formats_are_permuted():
    """Each small format is a permutation of itself: two letters with digits, phone numbers' last places, addresses of one network's size."""
    f = pii.Feistel(b"key")
    for n in (1, 2, 10, 97, 1000):
        made = [f.permute(x, n, b"t") for x in range(n)]
        assert sorted(made) == list(range(n)) and [f.permute(x, n, b"t", True) for x in made] == list(range(n))
    words = [f"{a}{b}{d}" for a in "aZ" for b in "xY" for d in range(10)]
    assert all(f.text(f.text(w, b"w"), b"w", True) == w and len(f.text(w, b"w")) == 3 for w in words)
    assert len({f.text(f"a{d}", b"w") for d in range(10)}) == 10


def test_versions_and_kin():
    matcher = license_scan.Matcher(license_scan.TEMPLATES)
    lesser = "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    older = lesser.replace("3", "2.1").replace("software:", "software;").replace("Foundation,", "Foundation;")
    want = {lesser: "LGPL-3.0", older: "LGPL-2.1", "Licensed under CC BY-SA 3.0.": "CC-BY-SA-3.0", "Licensed under CC BY-SA 2.0.": None, "Licensed under the GNU General Public License, version 1.": "GPL-1.0", "He said that all rights reserved by the state were void": None, "all rights reserved by none\n(c) X. All rights reserved.": "Proprietary", "Licensed under the Apache License, Version 1.1.": None, "SPDX-License-Identifier: 0BSD": "0BSD", "Distributed under the Boost Software License, Version 1.0.": "BSL-1.0"}
    assert {x: matcher.licence(x, 0.8)[0] for x in want} == want


def test_op10_rows(spark):
    """The whole query: each text's own licence, and for the others that of most notices in their block."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    matcher = license_scan.Matcher(license_scan.TEMPLATES)
    own = {r.doc_id: matcher.licence(r.text, 0.8) if r.text and re.search(license_scan.SPEAKS, r.text) else (None, None) for r in docs}
    folder = lambda r: "/".join(x for x in (r.source, r.lang, str(r.doc_id // 1000)) if x is not None)
    said = defaultdict(Counter)
    for r in docs:
        last = (r.text or "").rpartition("\n")[2]
        if re.search(license_scan.SPEAKS, last) and len(last.split()) <= 15 and own[r.doc_id][0]:
            said[folder(r)][own[r.doc_id][0]] += 1
    want = []
    for r in docs:
        licence, similarity = own[r.doc_id]
        near = min(said[folder(r)].items(), key=lambda x: (-x[1], x[0]))[0] if said[folder(r)] else None
        found = "own" if licence else "inherited" if near else "none"
        want.append((r.doc_id, f"{folder(r)}/{r.doc_id}.txt", licence or near, similarity, found, folder(r) if found == "inherited" else None))
    got = [tuple(r) for r in queries.op10_license_scan(spark, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and {x[4] for x in got} >= {"own", "inherited"}

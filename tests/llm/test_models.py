"""What operators learn or score, against plain versions of the same written apart."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
from conftest import SF

from lutrin.llm import license_scan, lm, pii, quality, queries, simhash, toxicity


def test_prediction_by_partial_matching():
    """Escape method C with exclusion, by dictionaries of contexts."""
    r = random.Random(9)
    train = [bytes(r.choices(b"abcd ", weights=(5, 3, 2, 1, 2), k=r.randrange(60))) for _ in range(30)]
    seen: dict[bytes, Counter] = defaultdict(Counter)
    pad = bytes([lm.PAD]) * lm.ORDER
    for t in train:
        whole = pad + t + bytes([lm.END])
        for i in range(lm.ORDER, len(whole)):
            for j in range(lm.ORDER + 1):
                seen[whole[i - j : i]][whole[i]] += 1

    def log10(context: bytes, byte: int) -> float:
        out, gone = 0.0, set()
        for j in range(lm.ORDER, -1, -1):
            here = seen.get(context[len(context) - j :])
            if here is None:
                continue
            left = {b: n for b, n in here.items() if b not in gone}
            total = sum(left.values()) + len(left)
            if byte in left:
                return out + math.log10(left[byte] / total)
            if left:
                out += math.log10(len(left) / total)
            gone |= here.keys()
        return out - math.log10(256 - len(gone))

    keys, counts = np.unique(lm.grams(train)[0], return_counts=True)
    model = lm.Model(keys, counts, *lm._sums(keys & 0xFFFF, counts))
    for t in [b"", b"abca abcd", b"zz", b"a z a", *(bytes(r.choices(b"abcdx ", k=30)) for _ in range(20))]:
        whole = pad + t + bytes([lm.END])
        want = sum(log10(whole[i - lm.ORDER : i], whole[i]) for i in range(lm.ORDER, len(whole)))
        assert abs(model.log10(lm.grams([t])[0]).sum() - want) < 1e-4


def test_posterior_of_rules():
    """EM over single rows, by loops, gives the same posteriors as over the counts of patterns."""
    r = random.Random(3)
    rows = []
    for _ in range(300):
        good = r.random() < 0.7
        rows.append(tuple(-1 if r.random() < 0.3 else int(good if r.random() < 0.85 else not good) for _ in range(4)))
    p = [1 / (1 + math.exp(3 * v.count(0) - v.count(1))) for v in rows]
    for _ in range(100):
        table = [[[1.0] * 3 for _ in range(4)] for _ in range(2)]
        weight = [1.0, 1.0]
        for v, g in zip(rows, p, strict=True):
            for c, w in ((0, 1 - g), (1, g)):
                weight[c] += w
                for k, x in enumerate(v):
                    table[c][k][x + 1] += w
        new = []
        for v in rows:
            odds = math.log(weight[1] / weight[0])
            for k, x in enumerate(v):
                one = math.log(table[1][k][x + 1] / sum(table[1][k])) - math.log(table[0][k][x + 1] / sum(table[0][k]))
                odds += min(one, -math.log(2)) if x == 0 else one
            new.append(1 / (1 + math.exp(-odds)))
        p = new
    counts = Counter(rows)
    keys = sorted(counts)
    got = dict(zip(keys, quality.expectation_maximisation(np.array(keys), np.array([counts[k] for k in keys], float)), strict=True))
    assert all(abs(got[v] - g) < 1e-6 for v, g in zip(rows, p, strict=True))


def test_lexicon_is_chosen_among_all_terms():
    """The heap gives what a look at all candidates in each step gives."""
    r = random.Random(8)
    for _ in range(20):
        where = {f"t{i}+": sorted(r.sample(range(80), r.randrange(1, 20))) for i in range(60)}
        rate = {x: r.choice([8.0, 9.5, 12.0, 30.0]) for x in where}
        left, want, pool = set(range(80)), [], set(where)
        while left and pool:
            best = min(pool, key=lambda x: (-len(left & set(where[x])) * math.log(rate[x]), -len(x), x))
            if len(left & set(where[best])) < 3:
                break
            want.append(best)
            left -= set(where[best])
            pool.remove(best)
        assert toxicity.choose(where, rate, 80, 3)[: len(want)] == want


def test_counts_of_terms_and_phrases(spark):
    rows = [(1, "ab abc zeta"), (0, "abc"), (1, "x_abc, abc"), (0, ""), (1, "abc abc")]
    found = spark.createDataFrame(rows, "y int, t string")
    got = {r.x: (r.n1, r.n0) for r in toxicity._counted(found, toxicity._terms).collect()}
    assert got["abc "] == (3, 1) and got["zet+"] == (1, 0) and "ab " not in got and got["x_a+"] == (1, 0)
    assert toxicity._phrases("one two, three x_abc end", [0, 4, 9, 17]) == {"one two", "two three", "three x_abc", "x_ abc", "abc end"}
    assert toxicity._phrases("only", [0]) == set()


def naive_cosines(text, templates):
    """The best stretch of each template, by vectors made one at a time."""
    word = lambda x: re.findall(r"[a-z0-9]+(?:\.[0-9]+)*", x.lower())
    all_words = [word(x) for _, x in templates]
    df = Counter(w for x in all_words for w in set(x))
    idf = lambda w: math.log((len(templates) + 1) / (df[w] + 1)) + 1
    vector = lambda x: {w: n * idf(w) for w, n in Counter(x).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    words = word(text)
    out = []
    for x in all_words:
        t, n, best = vector(x), min(len(x), len(words)), 0.0
        for i in range(len(words) - n + 1) if n else ():
            v = vector(words[i : i + n])
            best = max(best, sum(a * t.get(w, 0) for w, a in v.items()) / norm(v) / norm(t))
        out.append(best)
    return out


def test_cosines_of_stretches(monkeypatch):
    r = random.Random(1)
    templates = license_scan.TEMPLATES
    matcher = license_scan.Matcher(templates)
    texts = ["", "word", "All rights reserved", "licence " * 30]
    for _ in range(12):
        noise = lambda: " ".join(r.choice(["the", "software", "x1", "license", "of", "any", "and"]) for _ in range(r.randrange(40)))
        words = r.choice(templates)[1].split()
        texts.append(f"{noise()} {' '.join(w for w in words if r.random() < 0.95)} {noise()}")
    for size in (license_scan.PART_WORDS, 30):
        monkeypatch.setattr(license_scan, "PART_WORDS", size)
        for t in texts:
            want = {k: x for k, x in enumerate(naive_cosines(t, templates)) if x >= 0.6}
            got = {k: x for k, x, _, _ in matcher.best(t, 0.6)}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want), t


def test_whole_licences_and_headers():
    """Files and headers put together from the licences' own paragraphs, wrapped and commented as they are in real ones."""
    text = lambda name, *starts: "\n\n".join(next(t for n, t in license_scan.TEMPLATES if n == name and t.startswith(s)) for s in starts)
    wrapped = lambda t, mark: "\n".join(f"{mark} {line}" for line in re.findall(r".{1,60}(?:\s|$)", t.replace("\n\n", f"\n{mark}\n")))
    mit = "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + text("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (", "The above", "THE SOFTWARE")
    apache = text("Apache-2.0", "Licensed under the Apache License, Version 2.0 (", "Unless")
    gpl = text("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or")
    gpl2 = text("GPL-2.0", "GNU GENERAL", "The licenses", "This program")
    bsd = "Copyright (c) 1990 The Regents. All rights reserved.\n\n" + text("BSD-3-Clause", "Redistribution and use", "Redistributions", "Neither")
    disclaimer = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES ARE DISCLAIMED.'
    bsd2 = "Copyright (c) 1990 X. All rights reserved.\n\n" + text("BSD-2-Clause", "Redistribution and use", "Redistributions") + "\n\n" + disclaimer
    matcher = license_scan.Matcher(license_scan.TEMPLATES)
    cases = {"MIT": [mit], "Apache-2.0": [apache, text("Apache-2.0", "Apache License Version", "Grant")], "GPL-3.0": [gpl, text("GPL-3.0", "GNU GENERAL", "The GNU")], "GPL-2.0": [gpl2], "BSD-3-Clause": [bsd, bsd + "\n\n" + disclaimer], "BSD-2-Clause": [bsd2]}
    for name, texts in cases.items():
        for t in texts:
            for x in (t, t.replace("\n\n", " "), wrapped(t, "#"), wrapped(t, " *") + "\nint main() { return 0; }"):
                assert matcher.licence(x, 0.8)[0] == name, x
    assert matcher.licence("SPDX-License-Identifier: MIT\nAll rights reserved.", 0.8) == ("MIT", 1.0)
    assert matcher.licence("All rights reserved.", 0.8) == ("Proprietary", 1.0)
    for x in ("driver's licence", "my license is expired", "SPDX-License-Identifier: WTFPL", "copyright law reserves rights to all"):
        assert matcher.licence(x, 0.8) == (None, None)


def test_values_are_linked_however_written():
    names = pii.Pseudonyms(b"key")
    digits = lambda x: re.sub("[^0-9]", "", names.replace(x)[0])
    phones = ["+1 (555) 010-9999", "+1 555 010 9999", "+1-555-010-9999", "+15550109999"]
    assert len({digits(x) for x in phones}) == 1 and digits("+1 555 010 9999")[1:] == digits("(555) 010-9999") != "5550109999"
    assert digits("+33 1 23 45 67 89") == digits("+33123456789") and digits("+33 1 23 45 67 89").startswith("33")
    a, b = names.replace("Joe.B@Mail.Example.org")[0], names.replace("joe.b@mail.example.org")[0]
    assert a.lower() == b and a != b and "example" not in b and b.endswith(".org") and names.replace("ann@mail.example.org")[0].split("@")[1] == b.split("@")[1]
    for x in [*phones, "Joe.B@Mail.Example.org", "123-45-6789"]:
        assert names.replace(names.replace(x)[0], inverse=True)[0] == x
    for x in ("000-12-3456", "666-12-3456", "912-12-3456", "123-00-4567", "123-45-0000"):
        assert names.replace(x) == (x, [])


def test_social_security_numbers_are_permuted():
    """Every pseudonym is a valid number, and each comes from one number: brute force over the groups and serials of some areas."""
    names = pii.Pseudonyms(b"k")
    seen = set()
    for area in (1, 665, 667, 899):
        for k in range(1, 400):
            x = f"{area:03d}-{k % 99 + 1:02d}-{k * 25 % 9999 + 1:04d}"
            y = names.value("ssn", x)
            assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", y) and names.value("ssn", y, inverse=True) == x
            seen.add(y)
    assert len(seen) == 4 * 399


def test_recall_of_near_copies_at_the_threshold(spark):
    """Made pairs of just such similarity, one in each of many pairs that are alike to no other: brute force is their own Jaccard."""
    r = random.Random(80)
    shares = (0.80, 0.82, 0.85)
    rows, want = [], {}
    for g in range(450):
        share = shares[g % 3]
        words = [f"w{r.randrange(10**6)}" for _ in range(300)]
        copy = list(words)
        own = set(simhash.shingles(" ".join(words).encode(), 5))
        for at in r.sample(range(300), 60):
            old, copy[at] = copy[at], f"x{g}_{at}"
            other = set(simhash.shingles(" ".join(copy).encode(), 5))
            if len(own & other) < share * len(own | other):
                copy[at] = old
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
        want[2 * g, 2 * g + 1] = share
    groups = defaultdict(set)
    for n, root in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect():
        groups[root].add(n)
    got = {tuple(sorted(x)) for x in groups.values()}
    assert got <= want.keys()
    for share in shares:
        assert sum(want[x] == share for x in got) >= 0.95 * 150


def test_recall_of_near_copies_of_documents(spark):
    """All pairs of the documents at sf0.01 by shared shingles, joined into groups."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: frozenset(simhash.shingles((r.text or "").encode(), 5)) for r in docs.collect()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter()
    for ids in holders.values():
        for a in ids:
            for b in ids:
                if a < b:
                    common[a, b] += 1
    pairs = {(a, b) for (a, b), n in common.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}
    root = dict(simhash.near_copies(docs).collect())
    found = {(a, b) for a, b in pairs if a in root and root[a] == root.get(b)}
    assert len(pairs) > 20 and len(found) >= 0.99 * len(pairs)
    linked = {x for p in pairs for x in p} | {i for i, s in sets.items() if not s}
    assert root.keys() <= linked


def test_sql(spark):
    """Queries with SQL give DuckDB's rows on the smallest tables."""
    for name, sql in queries.ORACLE_SQL.items():
        con = duckdb.connect()
        for table in ("documents", "benchmark"):
            con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
        ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
        columns = sorted(ours.columns)
        assert columns == sorted(theirs.columns)
        assert sorted(map(tuple, ours[columns].values.tolist())) == sorted(map(tuple, theirs[columns].values.tolist())), name

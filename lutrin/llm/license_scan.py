"""Licence detection by sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

Templates are notices, headers and the paragraphs that licence texts are known by. Terms are words; inverse document frequencies
are those of the templates, a word of no template counting as one in none. A template is compared with every stretch of a text that has as many words
as it, wherever it starts and however it is wrapped, so a notice within a long line and a paragraph of a whole licence
are found alike. All stretches of a text are scored at once: dot products and lengths are differences of running sums. A text's licence
is that for which the templates found speak most: the sum of their similarities, each counting as many times as the template has words,
so the conditions of a licence outweigh an "All rights reserved." beside them; where several templates are like one stretch, the most similar counts.
A file without a licence of its own gets that of the nearest directory above it that has a licence file.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructField, StructType

from .common import settle, small

#: Notices, headers and paragraphs of common licences, several for each.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("Proprietary", "All rights reserved."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", 'Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT", "Licensed under the MIT license."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-3.0", "The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the works."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989 Copyright (C) 1989 Free Software Foundation, Inc."),
    ("GPL-1.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-3.0", "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."),
    ("AGPL-3.0", "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-only"),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-2-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-2-Clause", 'documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"'),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-1.0", "This work is licensed under the GNU General Public License, version 1."),
    ("LGPL-2.1", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "SPDX-License-Identifier: BSL-1.0"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED"),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    ("CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."),
]
#: Words that part one licence from its kin, which a notice must have all of and no others of. So must it the version's number.
KIN = {"lesser", "affero", "sharealike", "noncommercial", "noderivatives", "sa", "nc", "nd", "bsd", "0bsd"}
VERSION = re.compile(r"v?[0-9](?:\.[0-9]+)*")
#: A notice of so few words must be a clause of its own.
FEW_WORDS = 3
#: Texts without any of this have no stretch like a template.
SPEAKS = r"(?i)licen[cs]|copyright|rights\W+reserved|redistribut|spdx|public\W+domain|permission\W+(?:is|to)\W"
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
FILES = r"(?i)(^|/)(un)?(licen[cs]e|copying)([.-][^/]*)?$"
#: Words of a text that are scored at a time; stretches lie over the borders too.
PART_WORDS = 20_000


class Matcher:
    """The templates' vectors, and the best stretch of a text for each. Empty texts have none; of equal stretches the first counts."""

    def __init__(self, templates: list[tuple[str, str]]):
        words = [WORD.findall(x.lower()) for _, x in templates]
        self.names = [x for x, _ in templates]
        self.versions = [{x for x in w if VERSION.fullmatch(x)} for w in words]
        self.kin = [KIN.intersection(w) for w in words]
        self.clause = {i: re.compile(r"\W+".join(w) + r"[^\S\n]*(?:[.;!|)*/\n]|\Z)") for i, w in enumerate(words) if len(w) <= FEW_WORDS}
        self.sizes = list(map(len, words))
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for x in words for w in x}))}
        found = Counter(w for x in words for w in set(x))
        # 0: words of no template.
        self.idf = np.array([np.log((len(words) + 1) / (found[w] + 1)) + 1 for w in [None, *self.number]])
        tf = np.zeros((len(words), len(self.idf)))
        for i, x in enumerate(words):
            for w, n in Counter(x).items():
                tf[i, self.number[w]] = n
        self.dots = tf * self.idf**2
        self.length = np.sqrt((tf * self.idf) ** 2 @ np.ones(len(self.idf)))

    def best(self, text: str, threshold: float) -> list[tuple[int, float, int, int]]:
        """(template, cosine, from, to) of those that some stretch of the text is as similar to, at the first stretch where it is most."""
        words = WORD.findall(text.lower())
        out: dict[int, tuple[float, int, int]] = {}
        step, over = PART_WORDS, max(self.sizes)
        for at in range(0, max(1, len(words) - over + 1), step):
            for k, x, i, n in self._part(words[at : at + step + over], threshold):
                if k not in out or x > out[k][0]:
                    out[k] = (x, at + i, at + i + n)
        return [(k, *y) for k, y in sorted(out.items())]

    def _part(self, words: list[str], threshold: float) -> Iterator[tuple[int, float, int, int]]:
        if not words:
            return
        own: dict[str, int] = {}
        ids = np.array([self.number.get(w, 0) for w in words])
        same = np.array([own.setdefault(w, len(own)) for w in words])
        weight = self.idf[ids] ** 2
        squares = np.concatenate(([0.0], np.cumsum(weight)))
        sums = np.zeros((len(self.sizes), len(words) + 1))
        np.cumsum(self.dots[:, ids], axis=1, out=sums[:, 1:])
        order = np.argsort(same, kind="stable")
        for k, n in enumerate(self.sizes):
            n = min(n, len(words))
            dot = (sums[k, n:] - sums[k, :-n]) / self.length[k]
            # A stretch is at least as long as if its words were all different.
            bound = squares[n:] - squares[:-n]
            if not (dot >= (threshold - 1e-9) * np.sqrt(bound)).any():
                continue
            edge = np.zeros(len(words) + 1)
            for lag in range(1, n):  # a word's repeats within the stretch: each pair of places counts twice
                i, j = order[:-lag], order[lag:]
                near = (same[i] == same[j]) & (j - i < n)
                if not near.any():
                    break
                i, j = i[near], j[near]
                np.add.at(edge, np.maximum(j - n + 1, 0), 2 * weight[i])
                np.add.at(edge, i + 1, -2 * weight[i])
            length = np.sqrt(bound + np.cumsum(edge)[: len(bound)])
            cosine = np.round(np.minimum(dot / length, 1.0), 9)
            i = int(np.argmax(cosine))
            if cosine[i] >= threshold:
                yield k, float(cosine[i]), i, n

    def _means(self, k: int, words: list[str], a: int, b: int) -> bool:
        """Whether a stretch (or a word or two around it) has the template's version, and it has the template's words of KIN and no others."""
        return self.versions[k] <= set(words[max(0, a - 2) : b + 2]) and self.kin[k] == KIN.intersection(words[a:b])

    def licence(self, text: str, threshold: float) -> tuple[str | None, float | None]:
        """The licence that most is found of (ties: the first in the templates' order), and the similarity of its best template.

        A template doesn't count where one of another licence is more similar to half of its stretch.
        """
        low = text.lower()
        found = self.best(text, threshold)
        if found:
            words = WORD.findall(low)
            found = [(k, x, a, b) for k, x, a, b in found if self._means(k, words, a, b) and (k not in self.clause or self.clause[k].search(low))]
        said: dict[str, float] = {}
        most: dict[str, float] = {}
        for k, x, a, b in found:
            name = self.names[k]
            if any(y > x and self.names[j] != name and 2 * (min(b, d) - max(a, c)) >= b - a for j, y, c, d in found):
                continue
            said[name] = said.get(name, 0.0) + x * self.sizes[k]
            most[name] = max(x, most.get(name, 0.0))
        if not said:
            return None, None
        name = max(dict.fromkeys(self.names), key=lambda x: round(said.get(x, 0.0), 6))
        return name, most[name]


def scan(df: DataFrame, path: str = "path", text: str = "text", key: str = "doc_id", threshold: float = 0.8, licence_file: Column | None = None) -> DataFrame:
    """key, path, licence, similarity, found ('own', 'inherited' or 'none') and from_dir for each row.

    licence_file: which rows speak for their directory (by default by name). If a directory has several licences, that of
    more files counts, then the first by name. A file with several statements has the licence that most is said of, then the first in
    the templates' order. Null and empty texts have no statements; a null path has no directory. Texts are read whole, however long. Repeated
    rows give repeated rows. An empty table gives an empty table. Other columns are left out, so their names don't matter.
    """
    t = F.col(f"`{text}`").cast("string")
    named = licence_file if licence_file is not None else F.col(f"`{path}`").rlike(FILES)
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{path}`").cast("string").alias("path"), F.coalesce(named, F.lit(False)).alias("file"), F.when(t.rlike(SPEAKS), t).alias("t"))
    schema = StructType([*(f for f in rows.schema.fields if f.name != "t"), StructField("own", T.StringType()), StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(TEMPLATES)
        for batch in batches:
            got = [matcher.licence(x.as_py(), threshold) if x.is_valid else (None, None) for x in batch.column("t")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("key", "path", "file")), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=schema.fieldNames())

    folder = F.when(F.col("path").isNotNull(), F.regexp_replace("path", "/?[^/]*$", ""))
    own = settle(rows.mapInArrow(run, schema).withColumn("dir", folder))
    counted = own.where("file and own is not null and dir is not null").groupBy("dir", "own").count()
    declared = counted.groupBy("dir").agg(F.min_by("own", F.struct((-F.col("count")).alias("c"), "own")).alias("licence"))
    # Ancestors of each distinct directory, and the nearest that has a licence.
    dirs = settle(own.select("dir").where("dir is not null").distinct())
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("up")))
    climb = dirs.select("dir", F.explode(above).alias("x")).select("dir", "x.depth", F.col("x.up").alias("up"))
    near = climb.join(declared.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("licence", "up"), "depth").alias("y"))
    near = settle(near.select("dir", F.col("y.licence").alias("licence"), F.col("y.up").alias("from_dir")))
    found = F.when(F.col("own").isNotNull(), "own").when(F.col("licence").isNotNull(), "inherited").otherwise("none")
    out = own.join(small(near, DIRECTORIES), "dir", "left")
    return out.select(F.col("key").alias(key), "path", F.coalesce("own", "licence").alias("licence"), "similarity", found.alias("found"), F.when(F.col("own").isNull(), F.col("from_dir")).alias("from_dir"))


#: Directories with a licence above them (two paths and a name) up to this number are broadcast; beyond it the join is a shuffle.
DIRECTORIES = 100_000

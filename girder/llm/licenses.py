"""License scans: templates are retrieved by MinHash over overlapping windows and verified by containment.

Templates are classed by their number of shingles (1, up to 4, 8, 16 ...). For
a class of up to U shingles, a document's shingles are read in windows of 2 U
that overlap by U, so every place where a template may stand lies in one
window. Window and template share a band if one of their MinHash values is
equal. The number of bands follows from the least similarity that a window
with a contained template can have, so that a match is met with a chance of at
least ``GUARANTEE``. A template met this way is verified on the whole
document: the share of its distinct shingles that occur there.

Words are lower-cased (A-Z). A text with fewer words than a shingle is one
shingle as a whole. Null, empty or blank text has none. Repeated rows give
repeated matches. An empty table, or no template, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.kernels import WordHasher, mix, shingles, slices, text_bytes

SHINGLE = 5
PERCENT = 80
GUARANTEE = 0.9999

# Wording of common notices and licenses.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit-notice": "Released under the MIT License.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        'in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY '
        "KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files '
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is "
        "distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
        "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
}


def bands_needed(limit: int, percent: int, guarantee: float) -> int:
    """MinHash values that a class of up to ``limit`` shingles needs.

    A template of Q > U / 2 shingles with the share c contained in a window of
    2 U has similarity of at least c Q / (2 U + Q - c Q).
    """
    if limit == 1:
        return 1
    least = limit // 2 + 1 if limit > 4 else 2
    part = percent / 100 * least
    return math.ceil(math.log(1 - guarantee) / math.log(1 - part / (2 * limit + least - part)))


def prepare(texts: Mapping[str, str], size: int, percent: int, guarantee: float) -> tuple[dict, list]:
    """Shingles of the templates by name, and by class (limit, names, bands) what retrieves them.

    A band is (seed, presence of the leading 16 bits, MinHash values). Plain
    dictionaries, lists and arrays, so that executors need no copy of this package.
    """
    hasher = WordHasher()
    sets = {name: np.unique(shingles(hasher.words([t.encode()])[0], size)) for name, t in sorted(texts.items())}
    sets = {name: found for name, found in sets.items() if len(found)}
    members: dict[int, list[str]] = {}
    for name, found in sets.items():
        n = len(found)
        members.setdefault(1 if n == 1 else max(4, 1 << (n - 1).bit_length()), []).append(name)
    classes = []
    for limit, names in sorted(members.items()):
        bands = []
        for seed in mix(np.arange(1, bands_needed(limit, percent, guarantee) + 1, dtype=np.uint64)):
            values = np.array([(sets[n] ^ seed).min() for n in names], np.uint64)
            maybe = np.zeros(1 << 16, bool)
            maybe[(values >> np.uint64(48)).astype(np.int64)] = True
            bands.append((seed, maybe, values))
        classes.append((limit, names, bands))
    return sets, classes


def met(classes: list, tokens: np.ndarray, bounds: np.ndarray) -> set[tuple[int, str]]:
    """(text, template) pairs that share a band; ``tokens`` holds the shingles of texts one after the other."""
    out: set[tuple[int, str]] = set()
    for limit, names, bands in classes:
        # Blocks of ``limit`` shingles that do not cross texts; two in a row are a window.
        sizes = np.diff(bounds)
        blocks = -(-sizes // limit)
        heads = np.repeat(bounds[:-1], blocks) + limit * (np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        if not len(heads):
            continue
        owner = np.repeat(np.arange(len(sizes)), blocks)
        for seed, maybe, values in bands:
            least = tokens ^ seed
            if limit > 1:
                least = np.minimum.reduceat(least, heads)
                joined = least.copy()
                same = owner[1:] == owner[:-1]
                joined[:-1][same] = np.minimum(least[:-1], least[1:])[same]
                least = joined
            at = np.flatnonzero(maybe[(least >> np.uint64(48)).astype(np.int64)])
            for i in at.tolist():
                out.update((int(owner[i]), names[j]) for j in np.flatnonzero(values == least[i]))
    return out


def scan(
    docs: DataFrame,
    templates: Mapping[str, str] = TEMPLATES,
    size: int = SHINGLE,
    percent: int = PERCENT,
    guarantee: float = GUARANTEE,
) -> DataFrame:
    """(doc_id, license, template_size, shared, containment, first_word, last_word) of every template found in a text.

    The last two say where its shingles stand: the first word of the first and
    the last word of the last one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(prepare(templates, size, percent, guarantee))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        sets, classes = sent.value
        for whole in batches:
            for batch in slices(whole):
                words, counts = hasher.words(text_bytes(batch.column("text")))
                ends = np.cumsum(counts)
                tokens = [shingles(words[end - n : end], size) for n, end in zip(counts, ends, strict=True)]
                bounds = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
                rows = []
                for i, name in sorted(met(classes, np.concatenate(tokens), bounds)):
                    wanted = sets[name]
                    at = np.minimum(np.searchsorted(wanted, tokens[i]), len(wanted) - 1)
                    hits = np.flatnonzero(wanted[at] == tokens[i])
                    shared = len(np.unique(at[hits]))
                    if 100 * shared >= percent * len(wanted):
                        last = int(hits[-1]) + min(size, int(counts[i]))
                        rows.append((i, name, len(wanted), shared, shared / len(wanted), int(hits[0]), last - 1))
                found = list(zip(*rows, strict=True)) if rows else [()] * 7
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                columns = [batch.column("doc_id").take(pa.array(found[0], pa.int64()))]
                columns += [pa.array(c, k) for c, k in zip(found[1:], kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    columns, ["doc_id", "license", "template_size", "shared", "containment", "first_word", "last_word"]
                )

    fields = "doc_id long, license string, template_size long, shared long, containment double, first_word long, last_word long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, fields)

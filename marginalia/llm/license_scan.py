"""License statements in documents: MinHash bands over overlapping windows, exact containment.

A template is a set of word shingles. A document is cut into windows that overlap by two thirds, in sizes
that follow the templates: a template of up to ``2**c`` shingles is looked for in windows of ``3 * 2**c``
shingles that begin every ``2**c``, so a stretch of up to ``2**(c + 1)`` shingles lies in one of
them as a whole.

Retrieval. ``BANDS`` MinHash functions, one row a band. A window that holds ``CONTAINMENT`` of a
template's shingles has a Jaccard similarity to it of at least 0.4 / 3.1 = 0.129, hence shares no band with
probability (1 - 0.129)**96 < 2e-6. Windows with fewer template shingles of any kind than the
smallest template of their size needs can't contain one and are not sketched.

Verification. Distinct shingles in common, exact, on the sets of the window and of the template.

Defined results: null, empty and short texts have no matches; templates of fewer words than a
shingle are refused; repeated rows give equal results; without templates nothing matches; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialise
from . import text as t
from .workers import ship

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 96
MOST_SHINGLES = 1_000_000

# The statements and notices that the licenses themselves prescribe or suggest.
TEMPLATES = {
    "mit-statement": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "apache-2.0-statement": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0-statement": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0-statement": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}

_SEEDS = t.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * t.STEP)


def shingle_set(text: str) -> np.ndarray:
    found = t.words(pa.array([text], pa.string()), t.ALPHANUMERIC)
    if len(found.hash) < SHINGLE:
        raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
    return np.unique(t.shingle_hashes(found.hash, SHINGLE))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key per band: the smallest of the shingles under the band's hash function."""
    low = t.mix(shingles[:, None] ^ _SEEDS[None, :]).min(axis=0)
    return t.mix(low + np.arange(BANDS, dtype=np.uint64))


def size_class(n: int) -> int:
    """``c`` with ``2**(c - 1) < n <= 2**c``."""
    return max(0, int(n - 1).bit_length())


_SPAN = pa.struct(
    [
        ("size", pa.int32()), ("from", pa.int64()), ("to", pa.int64()),
        ("bands", pa.list_(pa.int64())), ("shingles", pa.list_(pa.int64())),
    ]
)


def _window_maker(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, needed = shared.value
        bits = t.quick_bits(table)
        for piece in t.pieces(batches, "text"):
            found = t.words(piece.column("text"), t.ALPHANUMERIC)
            hashes = t.shingle_hashes(found.hash, SHINGLE)
            at = t.member(hashes, table, bits)
            at = at[t.whole(found.first, SHINGLE)[at]]
            text = np.searchsorted(found.first, at, side="right") - 1
            windows: list[list[dict]] = [[] for _ in range(piece.num_rows)]
            for d in np.unique(text).tolist():
                a, n = int(found.first[d]), int(found.first[d + 1] - found.first[d]) - SHINGLE + 1
                own = at[text == d] - a
                for c, least in needed.items():
                    step = 1 << c
                    near = np.unique(np.concatenate([own // step - i for i in range(3)]))
                    for k in near[near >= 0].tolist():
                        begin, end = k * step, min(n, (k + 3) * step)
                        if np.searchsorted(own, end) - np.searchsorted(own, begin) < least:
                            continue
                        inside = np.unique(hashes[a + begin : a + end])
                        windows[d].append(
                            {
                                "size": c, "from": begin, "to": end + SHINGLE - 1,
                                "bands": t.signed(band_keys(inside)).tolist(), "shingles": t.signed(inside).tolist(),
                            }
                        )
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc"), piece.column("version"), pa.array(windows, pa.list_(_SPAN))],
                ["doc", "version", "windows"],
            )

    return run


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """``(name, size, n, bands, shingles)`` of the templates."""
    rows = []
    for name, text in templates.items():
        own = shingle_set(text)
        rows.append((name, size_class(len(own)), len(own), t.signed(band_keys(own)).tolist(), t.signed(own).tolist()))
    return spark.createDataFrame(rows, "name string, size int, n int, bands array<long>, template array<long>")


def scan(
    documents: DataFrame,
    templates: dict[str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """``(doc, matches)`` per document row.

    ``matches`` has for every template found its ``name``, the best ``containment`` and the window of
    words ``from``, ``to`` with it. ``templates`` maps names to texts; all of them together may have
    ``MOST_SHINGLES`` shingles, since their table is broadcast.
    """
    templates = TEMPLATES if templates is None else templates
    if containment < 0.8:
        raise ValueError("the bands are made for a containment of 0.8 and more")
    spark = documents.sparkSession
    ship(spark)
    sets = {name: shingle_set(text) for name, text in templates.items()}
    if sum(map(len, sets.values())) > MOST_SHINGLES:
        raise ValueError(f"templates have more than {MOST_SHINGLES} shingles")
    needed: dict[int, int] = {}
    for own in sets.values():
        c, least = size_class(len(own)), int(np.ceil(containment * len(own) - 1e-9))
        needed[c] = min(least, needed.get(c, least))
    table = np.unique(np.concatenate([*sets.values(), np.empty(0, dtype=np.uint64)]))
    rows = documents.select(
        F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("version"), F.col(text_col).alias("text")
    )
    kind = "size:int,from:long,to:long,bands:array<long>,shingles:array<long>"
    cut = rows.mapInArrow(
        _window_maker(spark.sparkContext.broadcast((table, needed))),
        f"doc long, version long, windows array<struct<{kind}>>",
    )
    cut = materialise(cut, "license-windows")
    known = template_table(spark, templates)
    windows = cut.select("doc", "version", F.explode("windows").alias("w")).select("doc", "version", "w.*")
    banded = windows.select("doc", "version", "size", "from", F.explode("bands").alias("key"))
    bands = known.select("name", "size", F.explode("bands").alias("key"))
    met = banded.join(F.broadcast(bands), ["size", "key"]).select("doc", "version", "size", "from", "name").distinct()
    # The window's own row again, for its shingles; both sides are as small as the matches are rare.
    place = ["doc", "version", "size", "from"]
    sides = windows.select(*place, "to", "shingles").dropDuplicates(place)
    both = met.join(sides, place).join(F.broadcast(known.select("name", "n", "template")), "name")
    share = F.size(F.array_intersect("shingles", "template")) / F.col("n")
    best = F.max_by(F.struct(share.alias("containment"), "from", "to"), F.struct(share, -F.col("from")))
    matched = both.filter(share >= containment).groupBy("doc", "version", "name").agg(best.alias("b"))
    matches = matched.groupBy("doc", "version").agg(
        F.array_sort(F.collect_list(F.struct("name", "b.containment", "b.from", "b.to"))).alias("matches")
    )
    found = matches.withColumnsRenamed({"doc": "hit_doc", "version": "hit_version"})
    same = F.col("doc").eqNullSafe(F.col("hit_doc")) & (F.col("version") == F.col("hit_version"))
    none = F.array().cast("array<struct<name:string,containment:double,from:long,to:long>>")
    return cut.select("doc", "version").join(found, same, "left").select("doc", F.coalesce("matches", none).alias("matches"))

"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along directories.

A line that is close to a template is a licence header of its file.  A file that is close to
a template as a whole is a licence file, and holds for its directory and all below it, up to
the next licence file.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farfield.llm.common import packed, stage, text_of

SIMILARITY = 0.8

#: Notices in common use, by SPDX name.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released into the public domain under CC0 1.0.",),
    "ISC": ("Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}

_TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


class Templates:
    """Unit TF-IDF vectors of all templates, as postings by term.

    ``rarity`` holds the inverse document frequencies over the templates, ``other`` that of
    any other term, ``most`` the largest weight that a term has in a vector.
    """

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        texts = [(name, Counter(terms(t))) for name, several in templates.items() for t in several]
        seen = Counter(t for _, found in texts for t in found)
        inverse = lambda df: math.log((1 + len(texts)) / (1 + df)) + 1
        self.names = [name for name, _ in texts]
        self.rarity = {t: inverse(n) for t, n in seen.items()}
        self.other = inverse(0)
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for k, (_, found) in enumerate(texts):
            size = math.sqrt(sum((n * self.rarity[t]) ** 2 for t, n in found.items()))
            for t, n in found.items():
                self.postings.setdefault(t, []).append((k, n * self.rarity[t] / size))
        self.most = {t: max(w for _, w in several) for t, several in self.postings.items()}

    def possible(self, inside: Counter, outside: int) -> bool:
        """Whether a text may be close to some template, given its counts of terms that
        templates have and the number of different other terms."""
        if not inside:
            return False
        dot = length = 0.0
        for t, n in inside.items():
            w = n * self.rarity[t]
            dot += w * self.most[t]
            length += w * w
        return dot * dot >= (SIMILARITY - 1e-9) ** 2 * (length + self.other * self.other * outside)

    def closest(self, found: list[str]) -> tuple[str, float] | None:
        """The closest template and its cosine, if that is at least ``SIMILARITY``."""
        counts = Counter(found)
        length, dots = 0.0, {}
        for t, n in counts.items():
            w = n * self.rarity.get(t, self.other)
            length += w * w
            for k, v in self.postings.get(t, ()):
                dots[k] = dots.get(k, 0.0) + w * v
        if not dots:
            return None
        best = max(dots, key=lambda k: (dots[k], -k))
        cosine = dots[best] / math.sqrt(length)
        return (self.names[best], min(1.0, cosine)) if cosine >= SIMILARITY - 1e-12 else None

    def scan(self, text: str) -> tuple[list[str], str | None, float]:
        """Licences of single lines, licence of the whole text, best cosine."""
        hits, inside, outside, rarity = [], Counter(), set(), self.rarity
        for line in text.split("\n"):
            found = terms(line)
            known = Counter([t for t in found if t in rarity])
            different = set(found)
            if self.possible(known, len(different) - len(known)):
                hits.append(self.closest(found))
            inside.update(known)
            outside |= different
        hits = [h for h in hits if h]
        whole = self.closest(terms(text)) if self.possible(inside, len(outside) - len(inside)) else None
        best = max([s for _, s in hits] + ([whole[1]] if whole else []), default=0.0)
        return sorted({name for name, _ in hits}), whole[0] if whole else None, best


def _scanned(templates: dict[str, tuple[str, ...]]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = Templates(templates)
        for batch in batches:
            scans = [model.scan(text) for text in batch["text"].to_pylist()]
            headers, wholes, scores = zip(*scans) if scans else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch["row"], pa.array(headers, pa.list_(pa.string())), pa.array(wholes, pa.string()), pa.array(scores, pa.float64())],
                names=["row", "headers", "whole", "similarity"],
            )

    return run


def scanned(
    files: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, keep: list[str] | None = None
) -> DataFrame:
    """``row, headers, whole, similarity``: licences in lines, licence of the whole text, best cosine.

    Null and empty texts have none.
    """
    rows = packed(files, text_of().alias("text"), keep=keep)
    kinds = rows.select("row", F.array(F.lit("")).alias("headers"), F.lit(None).cast("string").alias("whole"), F.lit(0.0).alias("similarity"))
    return rows.mapInArrow(_scanned(templates), kinds.schema)


def directories(path: Column) -> Column:
    """The directories a file lies in, the nearest last; the root is the empty one."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def inherited(files: DataFrame) -> DataFrame:
    """``row, path, headers, similarity, licence, origin``.

    ``files`` is what ``scanned`` returns, with a ``path`` in ``row``.  A file with headers
    has their licences, joined by AND; one without has those of the nearest directory above
    it that holds a licence file, ``origin``.  Of several licence files in a directory the
    first by path holds.  Null paths lie in no directory; repeated rows stay.
    """
    at = directories(F.col("row.path"))
    scans = stage(files.withColumn("at", F.monotonically_increasing_id()), "scans")
    marked = scans.filter(F.col("whole").isNotNull() & F.col("row.path").isNotNull())
    roots = marked.select(F.element_at(at, -1).alias("dir"), F.col("row.path").alias("path"), "whole")
    roots = stage(roots.groupBy("dir").agg(F.min(F.struct("path", "whole")).alias("m")).select("dir", "m.whole"), "roots")
    bare = scans.filter((F.size("headers") == 0) & F.col("row.path").isNotNull()).select("at", F.posexplode(at).alias("depth", "dir"))
    nearest = (
        bare.join(roots, "dir").groupBy("at")
        .agg(F.max(F.struct("depth", "dir", "whole")).alias("m")).select("at", F.col("m.dir").alias("origin"), "m.whole")
    ).withColumnRenamed("whole", "passed_on")
    own = F.when(F.size("headers") > 0, F.array_join("headers", " AND "))
    return scans.join(nearest, "at", "left").select(
        "row", F.col("row.path").alias("path"), "headers", "similarity", F.coalesce(own, "passed_on").alias("licence"), "origin"
    )

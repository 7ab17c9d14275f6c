"""Operator 1, licence scans: sparse TF-IDF cosine of headers and licence files to templates, then
inheritance from the nearest ancestor directory.

Every line of a file, every run of up to RUN lines, every paragraph, the leading comment block, and a file as
a whole, is a segment: a sparse vector of its terms, weighted by count * idf, compared with each notice's.
The whole file is compared with the full licence texts of licence_texts first, weighted by
(1 + ln count) * idf, as common words fill long texts; a file that reaches the threshold there is that text. Document frequencies of the template terms are counted over all
files; a term outside the templates has the idf of a term never seen, so that prose counts against a line.
A segment's licence is that of the template with the largest cosine if this reaches `threshold`; a file's
is that of its best segment, in case of ties lines before runs of lines before the whole, then the first line.

Only segments with an anchor are compared. Anchors are the heaviest template terms, just so many that a
segment without any of them has a cosine under the threshold with every template: nothing is missed.

A file without a licence of its own takes the one of the nearest directory above it that has a licence
file (LICENSE, LICENCE, COPYING, COPYRIGHT, NOTICE, UNLICENSE, any suffix) with a recognised licence; of
several in one directory that with the largest score, then the least name. The directories that files lie
in are made distinct and resolved by equi-joins on path prefixes before they are joined to the files, so
that a directory with a third of all files is one row until then.

Defined cases: a null text has no licence of its own; a null path has no ancestors; repeated rows give
equal rows; an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

import math
import pkgutil
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read, work_table

THRESHOLD = 0.6

# Short notices by which works state these licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Licensed under the BSD License"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights. Licensed under CC0 1.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("Proprietary", "All rights reserved"),
    ("Proprietary", "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited"),
]
#: Licences whose full text is in licence_texts.
FULL = ("Apache-2.0", "BSD", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0")
RUN = 12
#: No licence: it counts where none is found, and only with a word of OWNERS or as a line of its own.
RESERVED, OWNERS = "Proprietary", frozenset(("copyright", "©", "proprietary", "confidential", "unauthorized"))
LICENCE_FILE = r"(?i)^(?:licen[cs]e|copying|copyright|notice|unlicense)(?:[.-].*)?$"
_TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


_COMMENT = re.compile(r"\s*(?:[#;%*!]|//|/\*|--|<!--|\"\"\"|''')")
_FILLED = re.compile(r"[^\W_]")


def terms(text: str) -> Counter:
    return Counter(_TERM.findall(text.lower()))


def _reserves(counts: Counter) -> bool:
    return not OWNERS.isdisjoint(counts) or set(counts) <= {"all", "rights", "reserved"}


def full_texts() -> list[tuple[str, str]]:
    return [(name, pkgutil.get_data(__package__, f"licence_texts/{name}.txt").decode()) for name in FULL]


def damped(counts: Counter) -> dict[str, float]:
    return {t: 1 + math.log(c) for t, c in counts.items()}


def blocks(lines: list[str]) -> list[tuple[int, int]]:
    """Paragraphs, and the leading comment block, of more than RUN lines: first line and the one after the last."""
    out, at, n = [], 0, len(lines)
    while at < n:
        end = at
        while end < n and _FILLED.search(lines[end]):
            end += 1
        out.append((at, end))
        at = max(end, at + 1)
    end = 0
    while end < n and _COMMENT.match(lines[end]):
        end += 1
    return sorted({(a, b) for a, b in [*out, (0, end)] if b - a > RUN})


class Templates:
    """Weighted template vectors for given document frequencies (term -> files) among n files."""

    def __init__(self, df: dict[str, int], n: int, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        self.unseen = self._idf(0, n)
        self.vectors = [(name, text if isinstance(text, dict) else terms(text)) for name, text in templates]
        self.idf = {t: self._idf(df.get(t, 0), n) for _, v in self.vectors for t in v}
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        norms = []
        for i, (_, v) in enumerate(self.vectors):
            norm = math.sqrt(sum((c * self.idf[t]) ** 2 for t, c in v.items()))
            norms.append(norm)
            for t, c in v.items():
                self.by_term.setdefault(t, []).append((i, c * self.idf[t] / norm))
        self.anchors: set[str] = set()
        for _, v in self.vectors:
            weights = sorted(((c * self.idf[t], t) for t, c in v.items()), reverse=True)
            total = sum(w * w for w, _ in weights)
            rest = sum(w * w for w, t in weights if t not in self.anchors)
            for w, t in weights:
                if rest < (threshold - 1e-9) ** 2 * total:
                    break
                if t not in self.anchors:
                    self.anchors.add(t)
                    rest -= w * w

    @staticmethod
    def _idf(df: int, n: int) -> float:
        return math.log((n + 1) / (df + 1)) + 1

    def best(self, segment: str) -> tuple[str, float] | None:
        """Licence and cosine of the best template, in the order of the templates in case of ties."""
        return self.nearest(terms(segment))

    def nearest(self, counts: dict[str, float]) -> tuple[str, float] | None:
        dots: dict[int, float] = {}
        norm = 0.0
        for t, c in counts.items():
            w = c * self.idf.get(t, self.unseen)
            norm += w * w
            for i, x in self.by_term.get(t, ()):
                dots[i] = dots.get(i, 0.0) + w * x
        if not dots:
            return None
        i, dot = min(dots.items(), key=lambda d: (-round(d[1], 9), d[0]))
        return self.vectors[i][0], dot / math.sqrt(norm)

    def whole(self, counts: Counter) -> tuple[str, float] | None:
        """As nearest(), where the terms of the templates are weighty enough to reach the threshold."""
        known = rest = 0.0
        weights = damped(counts)
        for t, c in weights.items():
            if t in self.idf:
                known += (c * self.idf[t]) ** 2
            else:
                rest += c * c
        if known < (self.threshold - 1e-9) ** 2 * (known + rest * self.unseen**2):
            return None
        best = self.nearest(weights)
        return best if best and best[1] >= self.threshold else None

    def scan(self, text: str, full: Templates | None = None) -> tuple[str, float, int] | None:
        """Licence, score and line (0 for the whole, the first of several) of the best segment that reaches
        the threshold, or of the full text that the file is."""
        words = _TERM.findall(text.lower())
        if full and (best := full.whole(Counter(words))):
            return (*best, 0)
        if self.anchors.isdisjoint(words):
            return None
        found = None
        lines = text.split("\n")
        parts = [_TERM.findall(line.lower()) for line in lines]
        anchored = [not self.anchors.isdisjoint(p) for p in parts]
        useful = [not self.idf.keys().isdisjoint(p) for p in parts]

        def take(counts: Counter, number: int) -> None:
            nonlocal found
            best = self.nearest(counts)
            if not best or best[1] < self.threshold or (best[0] == RESERVED and not _reserves(counts)):
                return
            # rights may be reserved beside a licence
            gain = (best[0] != RESERVED) - (found is not None and found[0] != RESERVED)
            if found is None or gain > 0 or (gain == 0 and best[1] > found[1] + 1e-9):
                found = (*best, number)

        for i, part in enumerate(parts):
            if anchored[i]:
                take(Counter(part), i + 1)
        # a line without template terms at either end only lowers the cosine
        for i in range(len(parts)):
            if not useful[i] or True not in anchored[i : i + RUN]:
                continue
            counts, seen = Counter(parts[i]), anchored[i]
            for j in range(i + 1, min(i + RUN, len(parts))):
                counts.update(parts[j])
                seen = seen or anchored[j]
                if useful[j] and seen:
                    take(counts, i + 1)
        for a, b in blocks(lines):
            if True in anchored[a:b]:
                take(Counter(t for p in parts[a:b] for t in p), a + 1)
        if len(lines) > 1:
            take(Counter(words), 0)
        return found


def term_counts(texts: DataFrame, wanted: list[str]) -> tuple[dict[str, int], int]:
    """Files with each wanted term, and all files; texts has the column t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, counts, n = set(wanted), Counter(), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                if t:
                    counts.update(vocabulary.intersection(_TERM.findall(t.lower())))
        yield pa.RecordBatch.from_arrays([pa.array([*counts, ""], pa.string()), pa.array([*counts.values(), n], pa.int64())], names=["term", "n"])

    rows = texts.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()  # a row for each template term
    found = {r["term"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def scan(files: DataFrame, path: Column, text: str, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """keep (of files), path, and for the file's own licence: licence, score, line (0: the whole file)."""
    wanted = sorted({t for _, x in [*TEMPLATES, *full_texts()] for t in terms(x)})
    df, n = term_counts(files.select(F.col(text).cast("string").alias("t")), wanted)
    names = [f"__{i}" for i in range(len(keep))]
    rows = files.select(*[F.col(f"`{c}`").alias(x) for c, x in zip(keep, names, strict=True)], path.cast("string").alias("path"), F.col(text).cast("string").alias("t"))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("t").schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Templates(df, n, threshold=threshold)
        full = Templates(df, n, [(name, damped(terms(x))) for name, x in full_texts()], threshold)
        for batch in batches:
            out = [(model.scan(t, full) if t else None) or (None, None, None) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], "licence", "score", "line"])

    return rows.mapInArrow(run, f"{ddl}, licence string, score double, line int").toDF(*keep, "path", "licence", "score", "line")


def inherit(scanned: DataFrame) -> DataFrame:
    """scanned with origin (own, inherited or null), and origin_dir; licence and score filled from the
    nearest ancestor directory's licence file where a file has none."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    own = scanned.where("licence is not null and path is not null").withColumn("name", F.regexp_extract("path", r"[^/]*$", 0)).where(F.col("name").rlike(LICENCE_FILE))
    best = own.groupBy(folder.alias("dir")).agg(F.min(F.struct(-F.col("score"), "name", "licence")).alias("b"))
    licensed = work_table(best.select("dir", F.col("b.licence").alias("dir_licence"), (-F.col("b.col1")).alias("dir_score")), "licensed")
    needy = scanned.where("licence is null and path is not null").select(folder.alias("home")).distinct()
    parts = F.split("home", "/")
    above = needy.select("home", F.explode(F.when(F.col("home") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(parts)))).alias("depth"), parts.alias("parts")).select("home", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth")), "/").alias("dir"))
    nearest = work_table(above.join(licensed, "dir").groupBy("home").agg(F.max(F.struct("depth", "dir", "dir_licence", "dir_score")).alias("near")), "nearest")
    # files with a licence of their own stay out of the join; a stored side lets Spark split a large directory
    seeks = F.col("licence").isNull() & F.col("path").isNotNull()
    rows = scanned.where(seeks).withColumn("home", folder).join(nearest, "home", "left").drop("home")
    rows = rows.unionByName(scanned.where(~seeks).withColumn("near", F.lit(None).cast(nearest.schema["near"].dataType)))
    return rows.select(
        *[c for c in scanned.columns if c not in ("licence", "score")],
        F.coalesce("licence", "near.dir_licence").alias("licence"), F.coalesce("score", "near.dir_score").alias("score"),
        F.when(F.col("licence").isNotNull(), "own").when(F.col("near").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("licence").isNull(), F.col("near.dir")).alias("origin_dir"),
    )


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a tree of files: source / hundreds of ids / document, the first of each hundred its
    licence file."""
    name = F.when(F.col("doc_id") % 100 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.expr("cast(doc_id div 100 as string)"), name)
    found = inherit(work_table(scan(read(spark, sf_dir, "documents"), path, "text", ["doc_id"]), "scanned"))
    return found.select("doc_id", "path", "licence", "score", "line", "origin", "origin_dir")

"""License scans: TF-IDF cosine to templates, then inheritance from ancestor directories.

Method. Lines of a file that hold a cue (license, copyright, ...) are its header
candidates, and so is the whole paragraph of comment lines around one, without its
comment signs; a file named like a licence (LICENSE, COPYING, ...) is one as a
whole besides, compared with the full licence texts as well. Candidates and templates become sparse TF-IDF vectors over the templates' words;
the inverse document frequency of a word is counted over all files. A candidate
gets the template of highest cosine, if that reaches ``LEAST_COSINE``. A file
without a header of its own takes the license of the licence file in its nearest
ancestor directory, its own included, found by joining each of its ancestors'
paths with the licence files' directories.

Cases. A null or empty text has no header. A null path keeps its row, inherits
nothing and is no licence file. Paths may begin with a slash or not; empty steps
don't count. Of several licence files in a directory the best match counts, then
the first path. A licence file that is like no licence as a whole counts by its
lines. Ties between templates go to the first name. Rows of one id and path are told
apart by their texts; repeated rows get the same result. An empty table gives an empty result. Whole texts are scanned.
"""

from __future__ import annotations

import importlib.resources
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, materialize, small_batches

LEAST_COSINE = 0.6
#: Characters of a text that ``layout`` may take for a licence notice.
NOTICE = 500
_CUES = re.compile(
    r"licen[sc]e|copyright|copyleft|all rights reserved|spdx|redistribut|warrant|permission is hereby|public domain|cc by|cc0"
)
_LICENSE_FILE = re.compile(r"(?i)^(licen[sc]e|copying|unlicense|copyright|notice)([-._].*)?$")
_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")

# Notices by which projects state their license.
TEMPLATES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Released under CC0 1.0."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Released under the ISC License."],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def _full_texts() -> dict[str, str]:
    """Whole licence files by name, those in ``licence_texts`` and two that follow from them."""
    folder = importlib.resources.files(__package__) / "licence_texts"
    found = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in folder.iterdir() if f.name.endswith(".txt")}
    # the AGPL differs from the GPL by its name and one section
    found["AGPL-3.0"] = re.sub("(?i)GNU General Public", "GNU Affero General Public", found["GPL-3.0"])
    found["BSD-2-Clause"] = re.sub(r"(?s)\n3\. Neither.*?permission\.\n", "\n", found["BSD-3-Clause"])
    return found


FULL_TEXTS = _full_texts()

# A line of a comment: the sign that opens it, and what follows.
_COMMENT = re.compile(r"(?i)[ \t]*(?:#+|//+!?|/\*+!?|\*+/?|--+|;+|%+|<!--+|\"\"\"|\'\'\'|(?:rem|dnl)\b)(.*)")
_CLOSE = re.compile(r"[ \t]*(?:\*+/|--+>|\"\"\"|\'\'\')?[ \t\r]*$")
_BLOCK = re.compile(r"(?s)/\*.*?(?:\*/|\Z)|<!--.*?(?:-->|\Z)|\"\"\".*?(?:\"\"\"|\Z)|\'\'\'.*?(?:\'\'\'|\Z)")


def terms(text: str) -> Counter:
    return Counter(_TERM.findall(text.lower()))


def vocabulary(whole: bool = False) -> frozenset[str]:
    """Words of the notices, or of the full texts too."""
    found = frozenset(t for texts in TEMPLATES.values() for x in texts for t in terms(x))
    return found.union(*map(terms, FULL_TEXTS.values())) if whole else found


@dataclass(frozen=True)
class LicenseModel:
    """The templates as unit TF-IDF vectors; ``whole`` is the model for licence files."""

    idf: dict[str, float]
    vectors: tuple[tuple[str, dict[str, float]], ...]
    whole: LicenseModel | None = None

    def vector(self, text: str) -> dict[str, float]:
        """Words outside the templates count toward the length, at the rarest word's weight."""
        rare = max(self.idf.values(), default=1.0)
        v = {t: n * self.idf.get(t, rare) for t, n in terms(text).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {t: x / norm for t, x in v.items()}

    def match(self, text: str) -> tuple[str | None, float]:
        """The template of highest cosine, and the cosine."""
        v = self.vector(text)
        best, name = 0.0, None
        for n, t in self.vectors:
            cosine = sum(x * t[w] for w, x in v.items() if w in t)
            if cosine > best + 1e-12:
                best, name = cosine, n
        return name, min(best, 1.0)


def model_of(counts: dict[str, int], files: int) -> LicenseModel:
    def made(words: frozenset[str], texts: list[tuple[str, str]], whole: LicenseModel | None = None) -> LicenseModel:
        idf = {t: math.log((1 + files) / (1 + counts.get(t, 0))) + 1 for t in sorted(words)}
        plain = LicenseModel(idf, ())
        return LicenseModel(idf, tuple((n, plain.vector(x)) for n, x in sorted(texts, key=lambda t: t[0])), whole)

    notices = [(n, x) for n, texts in TEMPLATES.items() for x in texts]
    return made(vocabulary(), notices, made(vocabulary(True), [*notices, *FULL_TEXTS.items()]))


def paragraph(text: str, start: int, end: int, inside) -> tuple[int, int, str] | None:
    """The comment lines without a gap around the line [start, end); null if that is no comment.

    ``inside`` tells whether a place is in a block comment, whose lines need no sign.
    """

    def content(a: int, b: int) -> str | None:
        m = _COMMENT.match(text, a, b)
        if m is None and not inside(a):
            return None
        return _CLOSE.sub("", m[1] if m else text[a:b]).strip() or None

    own = content(start, end)
    if own is None:
        return None
    lines, a, b = [own], start, end
    while a > 0 and (c := content(p := text.rfind("\n", 0, a - 1) + 1, a - 1)) is not None:
        lines.append(c)
        a = p
    lines.reverse()
    while b < len(text):
        e = text.find("\n", b + 1)
        e = len(text) if e < 0 else e
        if (c := content(b + 1, e)) is None:
            break
        lines.append(c)
        b = e
    return (a, b, " ".join(lines)) if len(lines) > 1 else None


def candidates(path: str | None, text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, text) of what may state a license: lines with a cue, comments around them, or a whole licence file."""
    text = text or ""
    low = text.lower()
    out, done, past = [], 0, -1
    if text and path is not None and is_license_file(path):
        out.append((0, len(text), text))
    if len(low) != len(text):  # some capitals change length: keep the offsets
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    blocks: list[tuple[int, int]] | None = None
    for m in _CUES.finditer(low):
        if m.start() < done:
            continue
        a = text.rfind("\n", 0, m.start()) + 1
        b = text.find("\n", m.start())
        done = len(text) if b < 0 else b
        out.append((a, done, text[a:done]))
        if a < past:
            continue
        if blocks is None:
            blocks = [x.span() for x in _BLOCK.finditer(text)]
            firsts = [x for x, _ in blocks]
        found = paragraph(text, a, done, lambda at: (k := bisect_right(firsts, at)) > 0 and at < blocks[k - 1][1])
        if found:
            out.append(found)
            past = found[1]
    return out


def is_license_file(path: str) -> bool:
    return bool(_LICENSE_FILE.match(path.rstrip("/").rsplit("/", 1)[-1]))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: candidates (term null), and at the end files' counts of template words."""
    words = vocabulary(True)
    counts: Counter = Counter()
    n = 0
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64())
    names = ("id", "path", "h", "is_file", "is_part", "start", "end", "candidate", "term", "n")

    def rows(found) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=list(names))

    for b in batches:
        found = []
        for i, path, h, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
            n += 1
            counts.update(set(_TERM.findall((text or "").lower())) & words)
            whole = path is not None and is_license_file(path)
            found += [(i, path, h, whole, whole and k > 0, a, e, t, None, None) for k, (a, e, t) in enumerate(candidates(path, text))]
        yield rows(found)
    yield rows([(*[None] * 8, t, c) for t, c in [*counts.items(), ("", n)]])


def ancestors(path: Column) -> Column:
    """The directories of a path, from its own up to the root (empty)."""
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    n = F.greatest(F.size(steps) - 1, F.lit(0))
    return F.transform(F.sequence(n, F.lit(0), F.lit(-1)), lambda k: F.concat_ws("/", F.slice(steps, F.lit(1), k)))


def scan(files: DataFrame, id_col: str, path: Column, text_col: str = "text", least: float = LEAST_COSINE) -> DataFrame:
    """(id, license, cosine, start, end, origin, origin_path) for each row of ``files``.

    ``origin`` is ``header``, ``file``, ``inherited`` or ``none``; ``start`` and ``end``
    are the code points of the file's own statement, ``origin_path`` is the file that
    an inherited license comes from.
    """
    small_batches(files.sparkSession)
    # rows are told apart by id, path and text
    source = files.select(
        F.col(id_col).cast("long").alias("id"), path.cast("string").alias("path"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text")
    )
    schema = "id long, path string, h long, is_file boolean, is_part boolean, start int, end int, candidate string, term string, n long"
    got = materialize(source.mapInArrow(_extract, schema), "license-lines")
    totals = {r.term: r.n for r in got.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    model = model_of(totals, totals.get("", 0))
    kept = ["id", "path", "h", "is_file", "is_part", "start", "end"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(3).to_pylist()
            found = [(model.whole if f else model).match(t) for f, t in zip(files, b.column(7).to_pylist(), strict=True)]
            cols = [*b.columns[:7], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*kept, "license", "cosine"])

    lines = got.where("term is null").select(*kept, "candidate")
    scored = lines.mapInArrow(match, "id long, path string, h long, is_file boolean, is_part boolean, start int, end int, license string, cosine double")
    good = materialize(scored.where((F.col("cosine") >= least) & F.col("license").isNotNull()), "license-matches")
    # whole licence files before their parts, then best cosine, then first place: as the least of a struct, so that rows are summed before they move
    minus = (-F.col("cosine")).alias("minus")
    own = good.groupBy("id", "path", "h").agg(F.min(F.struct("is_part", minus, "start", "end", "license", "is_file")).alias("m"))
    own = materialize(own.select("id", "path", "h", "m.license", (-F.col("m.minus")).alias("cosine"), "m.start", "m.end", "m.is_file"), "license-own")
    folder = F.element_at(ancestors(F.col("path")), 1)
    licence_files = own.where("is_file and path is not null").groupBy(folder.alias("folder")).agg(
        F.min(F.struct(minus, "path", "license")).alias("f")
    )
    licence_files = materialize(licence_files.select("folder", "f.path", "f.license", (-F.col("f.minus")).alias("cosine")), "license-files")
    rows = source.select("id", "path", "h")
    key = own.toDF("own_id", "own_path", "own_h", "license", "cosine", "start", "end", "is_file")
    same = F.col("id").eqNullSafe(F.col("own_id")) & F.col("path").eqNullSafe(F.col("own_path")) & (F.col("h") == F.col("own_h"))
    out = rows.join(key, same, "left")
    # every distinct directory is resolved once, however many files it holds
    folders = rows.where("path is not null").select(folder.alias("d"), ancestors(F.col("path")).alias("up")).distinct()
    steps = folders.select("d", F.posexplode("up").alias("far", "folder"))
    small = licence_files.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    held = F.broadcast(licence_files) if small else licence_files
    inherited = steps.join(held, "folder").groupBy("d").agg(F.min(F.struct("far", "path", "license", "cosine")).alias("i"))
    inherited = materialize(inherited, "license-folders")
    if inherited.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        inherited = F.broadcast(inherited)
    out = out.withColumn("d", folder).join(inherited, "d", "left")
    taken = F.col("license").isNull() & F.col("i").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "path",
        F.when(taken, F.col("i.license")).otherwise(F.col("license")).alias("license"),
        F.when(taken, F.col("i.cosine")).otherwise(F.col("cosine")).alias("cosine"),
        "start",
        "end",
        F.when(F.col("is_file"), "file").when(F.col("license").isNotNull(), "header").when(taken, "inherited").otherwise("none").alias("origin"),
        F.when(taken, F.col("i.path")).alias("origin_path"),
    )


def layout(doc_id: Column, source: Column, text: Column) -> Column:
    """A path for a document of a table that has none.

    A source's documents lie in a folder for each 1,000 ids, and in it one for each
    100. A text of up to ``NOTICE`` characters whose last line has a cue is a licence
    file: of the upper folder if it has half as many or fewer, else of the lower one.
    Every other text is a file of the lower folder.
    """
    upper = F.concat_ws("/", F.coalesce(source, F.lit("unknown")), F.floor(doc_id / 1000).cast("string"))
    lower = F.concat_ws("/", upper, F.floor(doc_id / 100).cast("string"))
    size = F.length(text)
    last = F.lower(F.element_at(F.split(F.rtrim(text), "\n"), -1))
    notice = F.coalesce((size <= NOTICE) & last.rlike(_CUES.pattern), F.lit(False))
    name = F.coalesce(doc_id.cast("string"), F.lit("none"))
    return F.when(notice, F.concat_ws("/", F.when(size <= NOTICE // 2, upper).otherwise(lower), F.concat(F.lit("LICENSE."), name))).otherwise(
        F.concat_ws("/", lower, F.concat(name, F.lit(".txt")))
    )

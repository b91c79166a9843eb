"""License scans: TF-IDF cosine of notices to templates, then inheritance from directories.

Every line of a file and every run of two or three lines is a sparse vector of
its terms, weighted by how rare a term is among all lines of the corpus.  Its
cosine with a template's vector tells how alike they are.  A template counts
for a run if the cosine reaches ``ALIKE`` and both say the same telling terms:
versions, and words that one licence has and its relatives have not.  The best
run of the file decides.  Where two licences come within ``MARGIN`` on that run,
the one with more templates found in the file is taken, else the licence is
``unknown``.  Terms of no template only add to a run's length, which bounds its
cosine: runs whose bound lies below ``ALIKE`` are passed over, and nothing else
is.  In a licence file (by its name) the whole text is compared as well.  A line
``SPDX-License-Identifier:`` is taken literally and before everything else.

A file without a notice of its own takes the licence of the nearest directory
above it that has a licence file.  Directories, not files, are joined with
those above them; of several licence files in a directory the most alike
counts, then the smallest path.

Results for odd input: null or empty texts have no notice, but inherit; a null
path is a file at no place, which neither inherits nor hands down; repeated
rows give repeated results; an empty corpus gives an empty result.  Without a
notice ``similarity`` and ``line`` are null.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.words import slices, texts
from coppice.session import cut

ALIKE = 0.6
MARGIN = 0.05
RUN = 3
FILE_NAMES = r"(?i)^(un)?licen[cs]e|^copying|^notice"
UNKNOWN = "unknown"
SPDX = re.compile(rb"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]*[A-Za-z0-9.+)](?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+()-]*[A-Za-z0-9.+)])*)")

# The usual wordings of notices and titles, by SPDX name.
GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
FORMS = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
GNU = "{} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or any later version."
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-1.1", "Licensed under the Apache Software License, Version 1.1."),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("ISC", "ISC License"),
    ("ISC", "Released under the ISC License."),
    ("ISC", f"{GRANT}, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Zero-Clause BSD License"),
    ("0BSD", f"{GRANT}."),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", FORMS),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", FORMS),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-1.0", "Eclipse Public License - v 1.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC0-1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]
for _name, _what, _long in [("GPL", "This program", "General Public License"), ("LGPL", "This library", "Lesser General Public License"), ("AGPL", "This program", "Affero General Public License")]:
    for _version in {"GPL": ["2", "3"], "LGPL": ["2", "2.1", "3"], "AGPL": ["3"]}[_name]:
        _spdx = f"{_name}-{_version if '.' in _version else _version + '.0'}"
        TEMPLATES += [
            (_spdx, GNU.format(_what, _long, _version)),
            (_spdx, f"This work is licensed under the GNU {_long}, version {_version}."),
            (_spdx, f"GNU {_long} Version {_version}"),
            (_spdx, f"Licensed under the {_name} version {_version}."),
        ]
for _short, _long in [
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]:
    for _version in ("3.0", "4.0"):
        TEMPLATES += [
            (f"CC-{_short}-{_version}", f"Licensed under CC {_short} {_version}."),
            (f"CC-{_short}-{_version}", f"This work is licensed under a Creative Commons {_long} {_version} International License."),
        ]

# Words that tell a licence from its relatives, with the other ways to say them.
TELLING = {
    "affero": "affero", "lesser": "lesser", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "apache": "apache", "mit": "mit", "isc": "isc", "bsd": "bsd",
    "zero": "zero", "mozilla": "mozilla", "mpl": "mozilla", "eclipse": "eclipse", "epl": "eclipse", "cc0": "cc0", "by": "by", "attribution": "by",
    "nc": "nc", "noncommercial": "nc", "sa": "sa", "sharealike": "sa", "nd": "nd", "noderivatives": "nd", "noderivs": "nd", "provided": "provided",
}
_VERSION = re.compile(r"v?([0-9])(?:\.([0-9]))?(?:\.0)?")

_BLANKED = bytes(c if chr(c).isalnum() or c in b".-" or c >= 0x80 else 0x20 for c in range(256))
_TRIM = b".-"


def terms(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits, inner dots and dashes."""
    return [t for t in (w.strip(_TRIM) for w in text.lower().translate(_BLANKED).split()) if t]


def told(found: list[bytes]) -> frozenset[str]:
    """The telling terms among the terms of a notice, versions written alike."""
    out = set()
    creative = b"cc" in found or b"creative" in found
    for k, term in enumerate(found):
        if term == b"library" and found[k + 1 : k + 2] == [b"general"]:
            out.add("lesser")  # its name before version 2.1
        parts = term.decode(errors="replace").split("-")
        for n, part in enumerate(parts):
            if version := _VERSION.fullmatch(part):
                clauses = n + 1 < len(parts) and parts[n + 1] == "clause"
                out.add(f"{version[1]} clauses" if clauses else f"{version[1]}.{version[2] or 0}")
            elif part in TELLING and (creative or TELLING[part] not in ("by", "nc", "sa", "nd")):
                out.add(TELLING[part])
    return frozenset(out)


VOCABULARY = frozenset(t for _, wording in TEMPLATES for t in terms(wording.encode()))


class Templates:
    """Unit vectors of the templates, given in how many of ``n_lines`` each term occurs."""

    def __init__(self, n_lines: int, found: dict[bytes, int]):
        self.unknown = math.log(1 + n_lines) + 1
        self.rarity = {t: math.log((1 + n_lines) / (1 + found.get(t, 0))) + 1 for t in VOCABULARY}
        self.names = [name for name, _ in TEMPLATES]
        bags = [Counter(terms(wording.encode())) for _, wording in TEMPLATES]
        self.told = [told(terms(wording.encode())) for _, wording in TEMPLATES]
        self.places: dict[bytes, list[tuple[int, float]]] = {}
        for k, bag in enumerate(bags):
            length = math.sqrt(sum((n * self.rarity[t]) ** 2 for t, n in bag.items()))
            for t, n in bag.items():
                self.places.setdefault(t, []).append((k, n * self.rarity[t] / length))

    def cosines(self, found: list[bytes]) -> np.ndarray:
        """Cosine with every template that says the same telling terms, else 0."""
        products = np.zeros(len(self.names))
        square = 0.0
        for t, n in Counter(found).items():
            weight = n * self.rarity.get(t, self.unknown)
            square += weight * weight
            for k, share in self.places.get(t, ()):
                products[k] += share * weight
        mine = told(found)
        agree = np.array([t == mine for t in self.told])
        # Rounded, so that equally good notices tie whatever the order of their sums.
        return np.round(np.where(agree, products, 0) / math.sqrt(square), 9) if square else products


def _bounds(lines: list[list[bytes]], templates: Templates) -> list[tuple[float, int, int]]:
    """Runs with a term of a template, as an upper bound of their cosine, start and size; the largest bound first.

    A cosine is at most the share of the run's length that its template terms
    have.  Added up line by line, their length is no less than the run's, and the
    square of the others, each occurrence by itself, no more.
    """
    known = np.zeros(len(lines))
    other = np.zeros(len(lines))
    for k, line in enumerate(lines):
        met = [t for t in line if t in VOCABULARY]
        other[k] = len(line) - len(met)
        if met:
            known[k] = math.sqrt(sum((n * templates.rarity[t]) ** 2 for t, n in Counter(met).items()))
    runs = []
    for size in range(1, min(RUN, len(lines)) + 1):
        starts = len(lines) - size + 1
        own = sum(known[k : k + starts] for k in range(size))
        rest = sum(other[k : k + starts] for k in range(size)) * templates.unknown**2
        at = np.flatnonzero(own)
        bounds = own[at] / np.sqrt(own[at] ** 2 + rest[at])
        runs += zip(bounds.tolist(), at.tolist(), [size] * len(at), strict=True)
    return sorted(runs, reverse=True)


def notice(text: bytes, templates: Templates, whole: bool = False) -> tuple[str | None, float | None, int | None]:
    """Licence, cosine and line number of the best notice of a text."""
    if literal := SPDX.search(text):
        return literal[1].decode(), 1.0, 1 + text.count(b"\n", 0, literal.start())
    lines = [terms(line) for line in text.split(b"\n")]
    runs = [(start, size) for bound, start, size in _bounds(lines, templates) if bound + 1e-9 >= ALIKE]
    if whole and len(lines) > RUN:
        runs.append((0, len(lines)))
    best, where = (0.0, 0, 0), None
    found: set[int] = set()
    for start, size in runs:
        alike = templates.cosines([t for line in lines[start : start + size] for t in line])
        hits = np.flatnonzero(alike >= ALIKE)
        found.update(hits.tolist())
        if len(hits):
            which = int(alike.argmax())
            mine = (float(alike[which]), -start, -which)
            if mine > best:
                best, where = mine, alike
    if where is None:
        return None, None, None
    near = {templates.names[k] for k in np.flatnonzero(where >= max(ALIKE, best[0] - MARGIN))}
    votes = Counter(templates.names[k] for k in found if templates.names[k] in near).most_common(2)
    clear = len(votes) == 1 or votes[0][1] > votes[1][1]
    return votes[0][0] if clear else UNKNOWN, best[0], 1 - best[1]


def _line_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, found = 0, Counter()
    for batch in slices(batches):
        for text in texts(batch):
            for line in text.split(b"\n"):
                if here := VOCABULARY.intersection(terms(line)):
                    found.update(here)
                n += 1
    rows = [(b"", n), *found.items()]
    yield pa.record_batch(
        [pa.array([t for t, _ in rows], pa.binary()), pa.array([c for _, c in rows], pa.int64())], names=["term", "n"]
    )


def templates_of(files: DataFrame) -> Templates:
    """Templates weighted by all lines of all files; a count for each of their terms comes to the driver."""
    counts = files.select("text").mapInArrow(_line_counts, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    found = {bytes(r.term): r.n for r in counts.collect()}
    return Templates(found.pop(b"", 0), found)


def _folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _above(folder: Column) -> Column:
    """The folder and all above it."""
    parts = F.split(folder, "/")
    return F.array_distinct(
        F.concat(
            F.array(F.lit("")),
            F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
        )
    )


def notices(files: DataFrame, templates: Templates) -> DataFrame:
    """Files with ``license``, ``similarity``, ``line`` and ``folder``; and whether each ``is_license`` file."""
    kept = [c for c in files.columns if c != "text"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flags = batch.column(batch.schema.get_field_index("is_license")).to_pylist()
            found = [notice(t, templates, bool(whole)) for t, whole in zip(texts(batch), flags, strict=True)]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in [*kept, "is_license"]]
            yield pa.record_batch(
                [
                    *columns,
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] and round(f[1], 6) for f in found], pa.float64()),
                    pa.array([f[2] for f in found], pa.int64()),
                ],
                names=[*kept, "is_license", "license", "similarity", "line"],
            )

    name = F.regexp_extract("path", "[^/]*$", 0)
    flagged = files.select(*kept, F.coalesce(name.rlike(FILE_NAMES), F.lit(False)).alias("is_license"), "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flagged.drop("text").schema)
    made = flagged.mapInArrow(find, f"{kinds}, license string, similarity double, line bigint")
    return made.withColumn("folder", _folder(F.col("path")))


def scanned(files: DataFrame) -> DataFrame:
    """``doc_id``, ``repo`` and ``path`` with the licence, its ``origin`` and, if inherited, ``from_path``.

    ``files`` has these three columns and ``text``.
    """
    files = files.select("doc_id", "repo", "path", "text")
    found = cut(notices(files, templates_of(files)), "notices")
    heads = found.where("is_license AND license IS NOT NULL AND path IS NOT NULL")
    best = heads.groupBy("repo", "folder").agg(
        F.min(F.struct((-F.col("similarity")).alias("far"), "path", "license")).alias("head")
    )
    best = best.select("repo", F.col("folder").alias("above"), F.col("head.path").alias("from_path"), F.col("head.license").alias("handed"))
    folders = found.where("path IS NOT NULL").select("repo", "folder").distinct()
    upward = folders.select("repo", "folder", F.explode(_above(F.col("folder"))).alias("above"))
    nearest = (
        upward.join(best, ["repo", "above"])
        .groupBy("repo", "folder")
        .agg(F.max(F.struct(F.length("above").alias("depth"), "from_path", "handed")).alias("near"))
        .select("repo", "folder", "near.from_path", "near.handed")
    )
    joined = found.join(nearest, ["repo", "folder"], "left")
    own = F.col("license").isNotNull()
    placed = F.col("path").isNotNull()
    return joined.select(
        "doc_id",
        "repo",
        "path",
        F.coalesce("license", F.when(placed, F.col("handed"))).alias("license"),
        "similarity",
        "line",
        F.when(own & F.col("is_license"), F.lit("file"))
        .when(own, F.lit("header"))
        .when(placed & F.col("handed").isNotNull(), F.lit("inherited"))
        .alias("origin"),
        F.when(~own & placed, F.col("from_path")).alias("from_path"),
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: a repository for each source, folders by language and number.

    Short documents with a notice are the licence files of their folder.
    """
    number = F.col("doc_id").cast("string")
    folder = F.concat_ws("/", F.lit("src"), F.coalesce("lang", F.lit("none")), F.expr("cast(pmod(doc_id div 100, 50) as string)"))
    short = (F.length("text") < 400) & F.col("text").rlike(r"(?i)licen[cs]e|rights reserved")
    name = F.when(short, F.concat(F.lit("LICENSE-"), number)).otherwise(F.concat(number, F.lit(".txt")))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce("source", F.lit("")).alias("repo"),
        F.concat(folder, F.lit("/"), name).alias("path"),
        "text",
    )

"""License scan: TF-IDF cosine to templates, and inheritance from directories.

Windows of consecutive words, across line breaks and marks of comments, are compared as sparse
TF-IDF vectors of words and word pairs with templates of license notices of as many words.
A match needs the words that tell licenses apart and a cosine of ``least_cosine`` or more;
of matches that overlap the nearest stays.  All licenses found are returned, and the best is
the file's own license; a file named like a license file declares it for its directory.  A file without a notice inherits from the nearest directory above
it that declares one.

Plan
----
1. One scan finds notices where the texts are read; only short rows leave it.
2. Declarations are aggregated per directory before any join.
3. Directories, not files, look for their nearest declaring ancestor: each distinct
   directory is joined once with the declarations on every path above it, and the
   longest wins.  Files then meet the answer of their directory.

Defined results: null and empty texts and texts without a notice have no license of their
own; of equal matches the earliest window, then the first template counts, and a mere reservation of
all rights comes after every license; of several
license files in a directory the best match, then the smallest path counts; a null path is
the root; rows are independent, repeated rows stay; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.llm.stages import Stages, small_batches, text_or_empty

LEAST_COSINE = 0.5

# Notices by SPDX identifier.  Words between asterisks must stand in the text.
TEMPLATES = {
    "Apache-2.0": "Licensed under the *Apache* License, Version *2.0* (the License); you may not use "
    "this file except in compliance with the License.",
    "MIT": "*Permission* is *hereby* *granted*, free of *charge*, to any *person* *obtaining* a copy of "
    "this *software* and associated documentation files, to deal in the Software without restriction.",
    "GPL-3.0": "This program is free software; you can redistribute it and/or modify it under the "
    "terms of the GNU *General* *Public* *License* as *published* by the Free Software Foundation; "
    "either *version* *3* of the License, or (at your option) any later version.",
    "BSD-3-Clause": "Redistributions in binary form must reproduce the above copyright notice in the "
    "documentation. *Neither* the *name* of the copyright holder nor the names of its *contributors* "
    "may be used to *endorse* or promote products derived from this software.",
    "BSD-2-Clause": "*Redistribution* and use in *source* and *binary* *forms*, with or without "
    "*modification*, are *permitted* provided that the following conditions are met.",
    "ISC": "*Permission* to *use*, copy, *modify*, and/or *distribute* this software for any *purpose* "
    "with or without *fee* is hereby *granted*.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the *Mozilla* Public License, v. *2.0*.",
    "EPL-2.0": "This program is made available under the terms of the *Eclipse* Public License *2.0*.",
    "EPL-1.0": "This program is made available under the terms of the *Eclipse* Public License v *1.0*.",
    "BSL-1.0": "Distributed under the *Boost* *Software* License, Version *1.0*.",
    "Unlicense": "This is free and *unencumbered* software released into the *public* *domain*.",
    "Zlib": "This software is provided *as*-is, without any express or implied *warranty*. In no event "
    "will the authors be held liable for any damages. Permission is granted to anyone to use this "
    "software for any *purpose*, *including* *commercial* applications, and to *alter* it.",
    "Artistic-2.0": "Licensed under the *Artistic* License *2.0*.",
    "EUPL-1.2": "Licensed under the *European* *Union* Public License *1.2*.",
    "WTFPL": "Do What The *Fuck* You Want To *Public* *License*.",
    "CC0-1.0": "This work is dedicated to the public domain under *CC0* 1.0 Universal.",
    "Proprietary": "*All* *rights* *reserved*.",
}
# Other forms of notices, for the template they belong to.
SHORT_FORMS = {
    "Apache-2.0": (
        "Licensed under the *Apache* License, Version *2.0*.", "*Apache* License, Version *2.0*",
        "*Apache* License *2.0*", "SPDX-License-Identifier: *Apache*-*2.0*",
    ),
    "MIT": (
        "Released under the *MIT* *License*.", "Licensed under the *MIT* *License*.", "*MIT* *License*",
        "SPDX-License-Identifier: *MIT*",
    ),
    "BSD-3-Clause": (
        "*BSD* *3*-*Clause* License", "*3*-*clause* *BSD* License", "SPDX-License-Identifier: *BSD*-*3*-*Clause*",
    ),
    "BSD-2-Clause": (
        "*BSD* *2*-*Clause* License", "*2*-*clause* *BSD* License", "SPDX-License-Identifier: *BSD*-*2*-*Clause*",
    ),
    "ISC": ("*ISC* *License*", "SPDX-License-Identifier: *ISC*"),
    "MPL-2.0": ("*Mozilla* Public License, version *2.0*", "*MPL* *2.0*"),
    "EPL-2.0": ("*Eclipse* Public License, version *2.0*", "*EPL* *2.0*"),
    "EPL-1.0": ("*Eclipse* Public License, version *1.0*", "*EPL* *1.0*"),
    "BSL-1.0": ("SPDX-License-Identifier: *BSL*-*1.0*",),
    "Unlicense": ("SPDX-License-Identifier: *Unlicense*",),
    "Zlib": ("*zlib* *License*", "SPDX-License-Identifier: *Zlib*"),
    "Artistic-2.0": ("SPDX-License-Identifier: *Artistic*-*2.0*",),
    "EUPL-1.2": ("SPDX-License-Identifier: *EUPL*-*1.2*",),
    "WTFPL": ("SPDX-License-Identifier: *WTFPL*",),
    "CC0-1.0": (
        "*CC0* *1.0* Universal", "Licensed under *CC0*", "SPDX-License-Identifier: *CC0*-*1.0*",
        "*creativecommons*.org/*publicdomain*/*zero*/*1.0*",
    ),
}


def _gnu() -> Iterator[tuple[str, str]]:
    """Notices of the GNU licenses: headers, titles and short forms."""
    for tag, title in (("GPL", ""), ("LGPL", "*Lesser* "), ("LGPL", "*Library* "), ("AGPL", "*Affero* ")):
        for version in {"GPL": ("3.0", "2.0"), "LGPL": ("3.0", "2.1", "2.0"), "AGPL": ("3.0",)}[tag]:
            name, full = f"{tag}-{version}", f"GNU {title}*General* *Public* *License*"
            yield name, f"This work is licensed under the {full}, *version* *{version}*."
            yield name, f"{full}, *version* *{version}*, as published by the Free Software Foundation."
            yield name, f"{full} *version* *{version}*"
            yield name, f"{full} *v* *{version}*"
            yield name, (
                "This program is free software; you can redistribute it and/or modify it under the terms "
                f"of the {full} as *published* by the Free Software Foundation; either *version* "
                f"*{version}* of the License, or (at your option) any later version."
            )
            yield name, (
                f"under the terms of *version* *{version}* of the {full} as published by the Free Software Foundation."
            )
            yield name, f"*{tag}* *{version}*"
            yield name, f"*{tag}v* *{version}*"


def _creative_commons() -> Iterator[tuple[str, str]]:
    """Notices of the six Creative Commons licenses in their five versions."""
    words = {
        "BY": "*Attribution*", "SA": "*ShareAlike*", "NC": "*NonCommercial*", "ND": "*NoDerivatives*"
    }
    for parts in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"):
        short = "-".join(f"*{p}*" for p in parts.split("-"))
        spoken = [words[p] for p in parts.split("-")]
        for version in ("4.0", "3.0", "2.5", "2.0", "1.0"):
            name = f"CC-{parts}-{version}"
            yield name, f"Licensed under *CC* {short} *{version}*."
            yield name, f"*CC* {short} *{version}*"
            yield name, f"*creativecommons*.org/licenses/{short.lower()}/*{version}*"
            kind = {"4.0": "International", "3.0": "Unported"}.get(version, "Generic")
            spelled = "-".join(spoken)
            variants = {spelled: 0, spelled.replace("NonC", "Non-C").replace("ShareA", "Share-A"): 0}
            for joined in [*variants, *(v.replace("Derivatives", "Derivs") for v in variants if "ND" in parts)]:
                joined = joined.replace("*Non-", "*Non*-*").replace("*Share-", "*Share*-*")
                yield name, (
                    f"This work is licensed under a Creative *Commons* {joined} *{version}* {kind} License."
                )
                yield name, f"Creative *Commons* {joined} *{version}*"


#: Comes after every other license: it also stands in the headers of free ones.
LAST = "Proprietary"
_WORD = re.compile(r"([^\W\d_]+|\d+(?:\.[1-9]\d*)?)(?:\.0+\b)*|\d+")
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"


def _folded(text: str) -> str:
    return text.lower().replace("licence", "license").replace("cc0", "cczero ")


def _words(text: str) -> list[str]:
    """Words and numbers; 2.0 is 2, and marks of comments are no words."""
    return _WORD.findall(_folded(text))


def _terms(words: list[str]) -> Counter:
    return Counter(words) + Counter(zip(words, words[1:]))


class Templates:
    """TF-IDF vectors of the forms of notices, found by the words that they need."""

    def __init__(self, templates=TEMPLATES, short_forms=SHORT_FORMS):
        forms = [*templates.items(), *_gnu(), *_creative_commons()]
        forms += [(name, text) for name, more in short_forms.items() for text in more]
        # of the same words, the first form stands
        forms = list({tuple(_words(text)): (name, text) for name, text in reversed(forms)}.values())[::-1]
        counts = [_terms(_words(text)) for _, text in forms]
        holders = Counter(t for c in counts for t in c)
        self.names = [name for name, _ in forms]
        self.idf = {t: log((1 + len(forms)) / (1 + n)) + 1 for t, n in holders.items()}
        #: a term of no template is as rare as one of a single template
        self.rare = log((1 + len(forms)) / 2) + 1
        self.sizes = [len(_words(text)) for _, text in forms]
        self.needed = [
            frozenset(w for m in re.findall(r"\*([^*]+)\*", text) for w in _words(m)) for _, text in forms
        ]
        self.weights = []
        for c in counts:
            norm = sqrt(sum((n * self.idf[t]) ** 2 for t, n in c.items()))
            self.weights.append({t: n * self.idf[t] / norm for t, n in c.items()})
        #: forms by the needed word that the fewest forms have
        self.anchored: dict[str, list[int]] = {}
        for k, needed in enumerate(self.needed):
            anchor = min(needed, key=lambda w: (holders[w], w))
            self.anchored.setdefault(anchor, []).append(k)
        self.anchors = frozenset(self.anchored)

    def cosine(self, words: list[str], form: int) -> float:
        terms = _terms(words)
        norm = sqrt(sum((n * self.idf.get(t, self.rare)) ** 2 for t, n in terms.items()))
        of_form = self.weights[form]
        return sum(n * self.idf[t] * of_form[t] for t, n in terms.items() if t in of_form) / norm

    def notices(self, text: str, least_cosine: float) -> list[tuple[float, str, int]]:
        """(cosine, license, first word) of each license in the text, the best first: windows of
        consecutive words against forms of as many words, of overlapping ones the nearest."""
        words = _words(text)
        found = self.anchors.intersection(words)
        if not found:
            return []
        places: dict[str, list[int]] = {}
        for at, word in enumerate(words):
            places.setdefault(word, []).append(at)
        near = []
        for form in sorted(k for anchor in found for k in self.anchored[anchor]):
            needed, size = self.needed[form], self.sizes[form]
            if not needed <= places.keys():
                continue
            last = max(0, len(words) - size)
            rarest = min((places[w] for w in needed), key=len)
            starts = {s for at in rarest for s in range(max(0, at - size + 1), min(at, last) + 1)}
            for start in starts:
                window = words[start : start + size]
                if needed.issubset(window):
                    cosine = self.cosine(window, form)
                    if cosine >= least_cosine:
                        rank = (self.names[form] == LAST, -round(cosine, 9), start, form)
                        near.append((rank, cosine, start + len(window)))
        out: dict[str, tuple[float, str, int]] = {}
        taken = bytearray(len(words))
        for (_, _, start, form), cosine, end in sorted(near):
            if not any(taken[start:end]):
                taken[start:end] = b"\x01" * (end - start)
                out.setdefault(self.names[form], (cosine, self.names[form], start))
        return list(out.values())


def _line_of(text: str, word: int) -> int:
    """Number of the line that holds the word of this number."""
    folded = _folded(text)
    at = next(m.start() for k, m in enumerate(_WORD.finditer(folded)) if k == word)
    return folded.count("\n", 0, at)


def _notices(least_cosine: float):
    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            found = []
            for text in batch.column("text"):
                text = text.as_py()
                notices = templates.notices(text, least_cosine)
                best = (None, None, None, [])
                if notices:
                    cosine, name, word = notices[0]
                    best = (name, cosine, _line_of(text, word), [n for _, n, _ in notices])
                found.append(best)
            names, cosines, lines, licenses = zip(*found) if found else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("file_id"),
                    batch.column("path"),
                    pa.array(names, pa.string()),
                    pa.array(cosines, pa.float64()),
                    pa.array(lines, pa.int32()),
                    pa.array(licenses, pa.list_(pa.string())),
                ],
                names=["file_id", "path", "own_license", "cosine", "line", "own_licenses"],
            )

    return of_partition


def directory(path: Column) -> Column:
    """Path of the directory that holds ``path``; the root is empty."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def _above(path: Column) -> Column:
    """All directories at and above a directory, with the root."""
    names = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.when(path == "", 0).otherwise(F.size(names))),
        lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"),
    )


def scan_licenses(
    files: DataFrame,
    least_cosine: float = LEAST_COSINE,
    id_col: str = "file_id",
    path_col: str = "path",
    text_col: str = "text",
) -> DataFrame:
    """Per file: file_id, path, own_license, cosine, line, own_licenses (all found, the best
    first), license, declared_in (the directory it was inherited from) and basis: header,
    directory or none."""
    small_batches(files.sparkSession)
    stages = Stages(files.sparkSession, "licenses")
    found = stages.write(
        files.select(
            F.col(id_col).cast("long").alias("file_id"),
            F.coalesce(F.col(path_col), F.lit("")).alias("path"),
            text_or_empty(text_col).alias("text"),
        ).mapInArrow(
            _notices(least_cosine),
            "file_id long, path string, own_license string, cosine double, line int, own_licenses array<string>",
        ),
        "found",
    ).withColumn("directory", directory(F.col("path")))
    declared = (
        found.where(F.col("path").rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
        .groupBy("directory")
        .agg(
            F.min(F.struct((-F.col("cosine")).alias("rank"), "path", "own_license")).alias("best")
        )
        .select(F.col("directory").alias("above"), F.col("best.own_license").alias("declared"))
    )
    seeking = found.where("own_license is null").select("directory").distinct()
    nearest = (
        seeking.withColumn("above", F.explode(_above(F.col("directory"))))
        .join(declared, "above")
        .groupBy("directory")
        .agg(F.max(F.struct(F.length("above").alias("depth"), "above", "declared")).alias("near"))
        .select("directory", "near.above", "near.declared")
    )
    joined = found.join(nearest, "directory", "left")
    has_own = F.col("own_license").isNotNull()
    return joined.select(
        "file_id",
        "path",
        "own_license",
        "cosine",
        "line",
        "own_licenses",
        F.coalesce("own_license", "declared").alias("license"),
        F.when(~has_own, F.col("above")).alias("declared_in"),
        F.when(has_own, "header")
        .when(F.col("declared").isNotNull(), "directory")
        .otherwise("none")
        .alias("basis"),
    )

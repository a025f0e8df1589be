"""License scans: sparse TF-IDF cosine to templates, then inheritance from directories.

Headers are the lines of a file that hold one of the templates' key terms, compared with the notices
that licenses ask for or are named by: as a whole, by sentences, and by windows, which are all runs
of as many terms as a notice has that hold a key term, with running sums.  A license file (by its
name) is compared as a whole too, with the licenses' full texts.  Vectors are sparse:
weights of the terms that occur, term frequency times a logarithmic inverse of how many files hold
the term.  File counts of the templates' terms, of which there is a fixed number, are taken over
all files; terms that no template has weigh as if no file held them.

A directory has the license of the license files in it (the best match; of equal ones the first
by name of license).  A file without a license of its own takes that of its nearest ancestor
directory.  Only directories are joined with their ancestors: a directory with a third of all
files is one row there.

Edge cases: null and empty texts have no license of their own; an empty table gives no rows; very
long texts and lines are scanned whole, in time that grows with their length; of equal scores the
first license by name counts; null paths have no directory and inherit nothing; rows that repeat a
path are scanned each; extra columns pass through, and columns that are added replace ones of the
same name in whatever case.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, others, slices, utf8, with_columns, write_shared

# The notices that the licenses ask for or are commonly named by.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Released under the BSD License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0"],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0"],
    "proprietary": ["Copyright. All rights reserved"],
}
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
# Full texts of licenses.  Licenses whose texts are long (Apache, GPL, MPL) hold their
# own notice, which is found as a header.
TEXTS = {
    "MIT": "MIT License\n\nCopyright (c)\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
    + _AS_IS
    + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n",
    "ISC": "ISC License\n\nCopyright (c)\n\n" + _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _NO_WARRANTY + "\n",
    "0BSD": "Zero-Clause BSD\n\n" + _ISC + ".\n\n" + _NO_WARRANTY + "\n",
    "BSD-2-Clause": "Copyright (c)\n\n" + _BSD + "\n" + _BSD_END + "\n",
    "BSD-3-Clause": "Copyright (c)\n\n" + _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\n" + _BSD_END + "\n",
    "Zlib": "Copyright (c)\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.\n",
    "BSL-1.0": "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
    + _AS_IS.replace("PURPOSE AND", "PURPOSE, TITLE AND")
    + " IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
    + _AS_IS
    + " IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org>\n",
}
KEY_TERMS = re.compile(r"licen[sc]e|copyright|\bmit\b|apache|\bgnu\b|mozilla|\bcc0?\b|redistribut|permission is hereby|rights reserved", re.I)
THRESHOLD = 0.7
#: From this score on a license file is the license whose full text it matches best.
WHOLE = 0.9
LICENSE_FILE = re.compile(r"(^|/)(LICEN[SC]E|COPYING|NOTICE)[^/]*$", re.I)
_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


VOCABULARY = sorted({t for texts in (*TEMPLATES.values(), [*TEXTS.values()]) for x in texts for t in terms(x)})

#: Lengths of the notices, in terms.
LENGTHS = sorted({len(terms(x)) for texts in TEMPLATES.values() for x in texts})
#: Windows that are scored at a time.
PIECE = 1 << 16


def headers(text: str) -> Iterator[str]:
    """Lines that hold a key term, each once."""
    done = -1
    for m in KEY_TERMS.finditer(text):
        if m.start() > done:
            start, end = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
            done = end if end >= 0 else len(text)
            yield text[start:done]


def sentences(line: str) -> set[str]:
    """A line, and its sentences that hold a key term."""
    return {line, *(x for x in line.split(". ") if KEY_TERMS.search(x))}


def _rank(match: tuple[float, str]) -> tuple[float, list[int]]:
    """Better scores first, then names in order."""
    return match[0], [-ord(c) for c in match[1]]


class Matcher:
    """Cosines to the templates under given file counts of their terms."""

    def __init__(self, files: int, holders: dict[str, int]):
        self.unseen = 1 + math.log(1 + files)
        self.weight = {t: 1 + math.log((1 + files) / (1 + holders.get(t, 0))) for t in VOCABULARY}
        self.notices = [(name, self.vector(x)) for name, texts in TEMPLATES.items() for x in texts]
        self.texts = [(name, self.vector(x)) for name, x in TEXTS.items()]

    def vector(self, text: str) -> dict[str, float]:
        raw = {t: n * self.weight.get(t, self.unseen) for t, n in Counter(terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    def best(self, text: str, templates: list[tuple[str, dict[str, float]]]) -> tuple[float, str]:
        own = self.vector(text)
        return max(((round(sum(x * own.get(t, 0.0) for t, x in v.items()), 6), name) for name, v in templates), key=_rank)

    def possible(self, text: str) -> list[tuple[str, dict[str, float]]]:
        """The notices that something in ``text`` can match: no cosine exceeds the length of what
        of a notice's vector lies in the terms that occur."""
        own = set(terms(text))
        return [(name, v) for name, v in self.notices if sum(x * x for t, x in v.items() if t in own) >= (THRESHOLD - 1e-6) ** 2]

    def best_window(self, text: str, notices: list[tuple[str, dict[str, float]]] | None = None) -> tuple[float, str]:
        """The best match of any window of as many terms as a notice has that holds a key term.

        Running sums give every window's product with every notice, and the square of its own
        length: each occurrence of a term, and each pair of occurrences of one, adds to it.
        """
        lowered = text.lower()
        found = list(_TERM.finditer(lowered))
        number: dict[str, int] = {}
        ids = np.array([number.setdefault(m[0], len(number)) for m in found], dtype=np.int64)
        if not len(ids):
            return 0.0, ""
        of = np.array([self.weight.get(t, self.unseen) for t in number])
        starts = np.array([m.start() for m in found])
        hits = [m.start() for m in KEY_TERMS.finditer(lowered)]
        marked = np.zeros(len(ids) + 1, dtype=np.int64)
        np.add.at(marked, np.maximum(np.searchsorted(starts, hits, side="right") - 1, 0), 1)
        marked = np.concatenate([[0], np.cumsum(marked[:-1])])
        parts = [(name, np.array([v.get(t, 0.0) for t in number])) for name, v in notices or self.notices]
        best = (0.0, "")
        for n in LENGTHS:
            n = min(n, len(ids))
            for at in range(0, len(ids) - n + 1, PIECE):
                own = ids[at : at + PIECE + n - 1]
                windows = len(own) - n + 1
                sums = lambda x, n=n: np.subtract(*(np.concatenate([[0.0], np.cumsum(x)])[k] for k in (slice(n, None), slice(None, -n))))
                w = of[own]
                square = sums(w * w)
                for lag in range(1, n):
                    pairs = np.where(own[lag:] == own[:-lag], (w * w)[lag:], 0.0)
                    if pairs.any():
                        square += 2 * (np.concatenate([[0.0], np.cumsum(pairs)])[n - lag :] - np.concatenate([[0.0], np.cumsum(pairs)])[: windows])
                here = marked[at + n : at + n + windows] > marked[at : at + windows]
                if not here.any():
                    continue
                for name, part in parts:
                    score = float(np.max(np.where(here, sums(w * part[own]) / np.sqrt(square), 0.0)))
                    best = max(best, (round(score, 6), name), key=_rank)
        return best

    def scan(self, text: str, whole: bool) -> tuple[float, str]:
        """The best match of the headers and, for a license file, of the text as a whole.

        A license's full text decides by itself, as notices are parts of it and of its variants.
        """
        if whole and text.strip() and (full := self.best(text, self.texts))[0] >= WHOLE:
            return full
        found = []
        for line in set(headers(text)):
            if own := self.possible(line):
                found += [self.best_window(line, own), *(self.best(x, own) for x in sentences(line))]
        if whole and text.strip():
            found += [self.best(text, self.notices), full]
        return max(found, key=_rank, default=(0.0, ""))


def term_counts(files: DataFrame, text: str = "text") -> Matcher:
    """Counts over all files of the templates' terms, as a matcher."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, n = set(VOCABULARY), Counter(), 0
        for batch in slices(batches, "utf8"):
            for raw in batch.column(0).to_pylist():
                n += 1
                # Lower-case letters of ASCII only can make up a term, so bytes do.
                total.update(known.intersection(terms(raw.decode("utf-8", "replace"))))
        names = ["", *total]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([n, *total.values()], pa.int64())], names=["term", "n"])

    counts = files.select(utf8(f"`{text}`").alias("utf8")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    holders = {r.term: r.n for r in counts.collect()}  # a row for each term of the templates at most
    return Matcher(holders.pop("", 0), holders)


def scanned(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """``files`` without ``text``, with own_license and own_score (null and 0 without a match)."""
    matcher = term_counts(files, text)
    raw, name = free_name(files, "utf8"), path
    kept = others(files, text, "own_license", "own_score")
    schema = T.StructType([files.schema[c] for c in kept] + [T.StructField("own_license", T.StringType()), T.StructField("own_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, raw):
            columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (raw, name))
            found = [matcher.scan(t.decode("utf-8", "replace"), bool(LICENSE_FILE.search(p or ""))) for t, p in zip(*columns)]
            own = [(m, s) if s >= THRESHOLD else (None, 0.0) for s, m in found]
            yield with_columns(batch, (raw,), own_license=pa.array([m for m, _ in own], pa.string()), own_score=pa.array([s for _, s in own], pa.float64()))

    return files.select(*[F.col(f"`{c}`") for c in kept], utf8(f"`{text}`").alias(raw)).mapInArrow(run, schema)


def inherited(files: DataFrame, declares: str, path: str = "path") -> DataFrame:
    """``files`` (with own_license and own_score) with license and license_from.

    ``declares``: a Boolean column, whether a file's license holds for its directory.
    """
    folder = free_name(files, "li_dir")
    parent = F.when(F.col(path).contains("/"), F.regexp_replace(path, "/[^/]*$", ""))
    keyed = files.withColumn(folder, parent)
    told = keyed.where(F.col(declares) & F.col("own_license").isNotNull() & F.col(folder).isNotNull())
    told = told.groupBy(F.col(folder).alias("of")).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("name"))).alias("best"))
    told = told.select("of", F.col("best.name").alias("name"))
    folders = keyed.select(F.col(folder).alias("dir")).where("dir is not null").distinct()
    parts = F.split("dir", "/")
    levels = folders.select("dir", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("level"))
    levels = levels.withColumn("of", F.array_join(F.slice(parts, F.lit(1), F.col("level")), "/"))
    nearest = levels.join(told, "of").groupBy("dir").agg(F.max(F.struct("level", "of", "name")).alias("near")).select("dir", "near")
    # Both sides keep their own names: no column of the files can be mistaken for one of these.
    rows, near = keyed.alias("rows"), nearest.alias("nearest")
    out = rows.join(near, F.col(f"rows.`{folder}`") == F.col("nearest.dir"), "left")
    return out.select(
        *[F.col(f"rows.`{c}`") for c in others(files, "license", "license_from")],
        F.coalesce("rows.own_license", "nearest.near.name").alias("license"),
        F.when(F.col("rows.own_license").isNotNull(), F.col(f"rows.`{path}`")).otherwise(F.col("nearest.near.of")).alias("license_from"),
    )


def tree_path() -> str:
    """SQL for a document's path: source, language, and a directory for each digit but the last two.

    A text of which one of the first two lines, or the last, is on a license, a copyright or a
    permission is a license file of its directory, however long; any other is a plain file.
    """
    digits = "cast(doc_id as string)"
    head = f"substring({digits}, 1, greatest(0, length({digits}) - 2))"
    about = "(licen[sc]e|copyright|public domain|permission to use)"
    is_license = f"text rlike '(?i)\\\\A\\\\s*([^\\\\n]*\\\\n\\\\s*)?[^\\\\n]*{about}' or text rlike '(?i){about}[^\\\\n]*\\\\s*\\\\z'"
    name = f"if(coalesce({is_license}, false), concat('LICENSE-', {digits}), concat({digits}, '.txt'))"
    return f"concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), nullif(array_join(split({head}, ''), '/'), ''), {name})"


def licensed(docs: DataFrame) -> DataFrame:
    """doc_id, path, own_license, own_score, license, license_from of documents in a tree of paths.

    Documents with a notice of their own speak for their directory.
    """
    files = docs.select("doc_id", F.expr(tree_path()).alias("path"), "text")
    found = write_shared(scanned(files), "licenses").withColumn("declares", F.col("own_license").isNotNull())
    return inherited(found, "declares").drop("declares")

"""Licence scan by the Dice coefficient over word bigrams.

A text's lines, the text as a whole and every window of its words are normalised to lower-case
words of letters and digits and compared to the templates, as sets of neighbouring words. Templates
are one-line notices and the headers and full texts in ``licence_texts``. Dice of at least ``least``
needs sizes within ``least / (2 - least)`` of each other, and so large a part of the template in the
text; so most lines and texts have no candidate template. Of windows that overlap, the one that
shares most with its template counts; one inside a line that matches as a whole is that line's.

Nulls and empty texts match nothing; ties between templates go to the first name. Each matching
line is a row of its own, so repeated lines and rows repeat. An empty table gives no rows. Only
doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm.common import table

DICE = 0.8
#: Notices by which the licences are usually declared.
TEMPLATES = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
)
TEMPLATES += tuple((p.name.removesuffix(".txt").removesuffix(".header"), p.read_text()) for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")))
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def bigrams(text: str) -> frozenset:
    found = _WORD.findall(text.lower())
    return frozenset(zip(found, found[1:], strict=False))


class Scanner:
    def __init__(self, templates=TEMPLATES, least: float = DICE):
        self.least = least
        self.by_size: dict[int, list] = {}
        for name, text in sorted(templates):
            grams = bigrams(text)
            self.by_size.setdefault(len(grams), []).append((name, grams))
        self.all = [t for ts in self.by_size.values() for t in ts if t[1]]
        self.within: dict[tuple, list[int]] = {}
        for k, (_, grams) in enumerate(self.all):
            for g in grams:
                self.within.setdefault(g, []).append(k)
        ratio = self.ratio = least / (2 - least)
        top = int(max(self.by_size) / ratio) + 1
        self.candidates = {n: [t for m, ts in self.by_size.items() if m and min(n, m) >= ratio * max(n, m) for t in ts] for n in range(1, top + 1)}

    def windows(self, text: str) -> list[tuple[int, int, str, float]]:
        """First and last line, licence and Dice of windows, the best of those that overlap."""
        shared = self.within.keys() & bigrams(text)
        held = Counter(k for g in shared for k in self.within[g])
        near = [k for k, n in held.items() if n >= self.ratio * len(self.all[k][1]) - 1e-9]
        if not near:
            return []
        spots = [(m.group(), m.start()) for m in _WORD.finditer(text)]
        found = [w.lower() for w, _ in spots]
        grams, hits = list(zip(found, found[1:], strict=False)), []
        for k in near:
            name, template = self.all[k]
            m = len(template)
            for left in (i for i, g in enumerate(grams) if g in template):
                seen, meet, best = set(), 0, (0.0, 0, 0)
                for right in range(left, len(grams)):
                    g = grams[right]
                    if g not in seen:
                        seen.add(g)
                        if len(seen) * self.ratio > m + 1e-9:
                            break
                        if g in template:
                            meet += 1
                            best = max(best, (2 * meet / (len(seen) + m), meet, right))
                if best[0] >= self.least:
                    hits.append((-best[1], -best[0], name, left, best[2]))
        out, taken = [], bytearray(len(grams))
        for _, dice, name, left, right in sorted(hits):
            if not any(taken[left : right + 1]):
                taken[left : right + 1] = b"\1" * (right + 1 - left)
                out.append((text.count("\n", 0, spots[left][1]) + 1, text.count("\n", 0, spots[right + 1][1]) + 1, name, -dice))
        return sorted(out)

    def best(self, text: str) -> tuple[str, float] | None:
        grams = bigrams(text)
        scored = [(-2 * len(grams & t) / (len(grams) + len(t)), name) for name, t in self.candidates.get(len(grams), ())]
        dice, name = min(scored, default=(0, ""))
        return (name, -dice) if -dice >= self.least else None


def scan(docs: DataFrame, templates=TEMPLATES, least: float = DICE) -> DataFrame:
    """doc_id, line (from 1, a window's first; 0 is the whole text), licence, dice."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates, least)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch._id, batch.text, strict=True):
                lines = text.split("\n")
                units = list(enumerate(lines, 1)) + [(0, text)] * (len(lines) > 1)
                hits = [(at, *hit) for at, unit in units if (hit := scanner.best(unit))]
                whole = {at for at, *_ in hits}
                hits += [(at, *hit) for at, end, *hit in scanner.windows(text) if at < end or at not in whole]
                out += [(doc_id, *hit) for hit in hits]
            yield pd.DataFrame(out, columns=["_id", "line", "licence", "dice"])

    source = docs.select(F.col("doc_id").cast("string").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = source.mapInPandas(run, "_id string, line bigint, licence string, dice double")
    return found.select(F.col("_id").cast("bigint").alias("doc_id"), "line", "licence", "dice")


def op1_licence_dice(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))

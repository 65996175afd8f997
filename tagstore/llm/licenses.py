"""Licence scans: lines, paragraphs, whole texts and template-sized word windows against templates by the Dice coefficient over word bigrams."""

from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, functions as F, types as T

from ._common import gram_hashes, lower_ascii, lut, text_buffer, word_hashes, word_spans

CUT = 0.8
#: Licence id -> template texts: short notices and headers as they stand in files, openings, and the full texts of licence_texts/.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "ISC": ["Released under the ISC License."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
}
for _file in sorted((Path(__file__).parent / "licence_texts").glob("*.txt")):
    TEMPLATES.setdefault(_file.stem, []).append(_file.read_text(encoding="utf-8"))
_WORD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def bigrams(data: bytes) -> Counter:
    """Word bigrams with their counts: A-Z lower-cased, all ASCII but letters and digits as blanks; one word alone is a gram."""
    w = data.translate(_WORD).split()
    return Counter(zip(w, w[1:])) if len(w) != 1 else Counter([(w[0],)])


class Scanner:
    def __init__(self, templates=TEMPLATES, cut=CUT):
        self.cut = cut
        self.known = [(name, i, g, sum(g.values())) for name, ts in sorted(templates.items()) for i, t in enumerate(ts) if (g := bigrams(t.encode()))]
        sizes = [n for *_, n in self.known]
        low, high = cut / (2 - cut), (2 - cut) / cut
        self.bounds = (min(sizes) * low, max(sizes) * high) if sizes else (1, 0)
        self.index = {}
        for t, (_, _, g, n) in enumerate(self.known):
            for x in g:
                self.index.setdefault(x, []).append((t, g[x]))
        self.ranges = [(n * low, n * high) for n in sizes]
        self.words = {w for g in self.index for w in g}
        hashed = [self.grams(np.frombuffer(" ".join(ts[i].split()).encode(), np.uint8)) for name, ts, i in ((name, templates[name], i) for name, i, *_ in self.known)]
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashed]))
        self.counts = np.zeros((len(hashed), len(self.vocabulary)), np.int32)
        for t, g in enumerate(hashed):
            np.add.at(self.counts[t], np.searchsorted(self.vocabulary, g), 1)

    @staticmethod
    def grams(buf):
        """Hashes of the word bigrams of one text."""
        buf = lower_ascii(buf)
        s, e, _ = word_spans(buf, np.array([0, len(buf)]), lut("alnum"))
        return gram_hashes(word_hashes(buf, s, e), 2)

    def best(self, data: bytes):
        """(dice, template, shared bigrams) of the best template with at least `cut`, or None; ties go to the first template."""
        w = data.translate(_WORD).split()
        n = max(len(w) - 1, min(len(w), 1))
        if not self.bounds[0] <= n <= self.bounds[1] or self.words.isdisjoint(w):
            return None
        grams = list(zip(w, w[1:])) if len(w) != 1 else [(w[0],)]
        if (2 - self.cut) * sum(map(self.index.__contains__, grams)) < self.cut * n - 1e-9:  # no template can share more
            return None
        grams = Counter(grams)
        shared = {}
        for x, c in grams.items():
            for t, k in self.index.get(x, ()):
                lo, hi = self.ranges[t]
                if lo <= n <= hi:
                    shared[t] = shared.get(t, 0) + min(c, k)
        top = max(((2 * s / (n + self.known[t][3]), -t) for t, s in shared.items()), default=None)
        return (top[0], -top[1], shared[-top[1]]) if top and top[0] >= self.cut else None

    def windows(self, buf, off):
        """Per row with any: (words' starts, words' ends, windows), where a window is (shared, bigrams, template, first word).

        All windows with as many bigrams as a template that reach the cut. Bigrams are counted as
        often as the template holds them: an occurrence counts in the windows that hold it but not
        the occurrence that is so many before it.
        """
        s, e, row = word_spans(buf := lower_ascii(buf), off, lut("alnum"))
        g = gram_hashes(word_hashes(buf, s, e), 2)
        if not len(g) or not len(self.vocabulary):
            return {}
        at = np.minimum(np.searchsorted(self.vocabulary, g), len(self.vocabulary) - 1)
        pos = np.flatnonzero((row[1:] == row[:-1]) & (self.vocabulary[at] == g))
        x = at[pos]
        first = np.searchsorted(row, np.arange(len(off)))
        found = []
        for t, (*_, n) in enumerate(self.known):
            need = max(1, int(np.ceil(self.cut * n - 1e-9)))
            k = self.counts[t][x]
            p = pos[k > 0]
            if len(p) < need:
                continue
            near = (p[need - 1 :] - p[: len(p) - need + 1] < n) & (row[p[need - 1 :]] == row[p[: len(p) - need + 1]])
            if not near.any():
                continue
            here = np.zeros(len(off), bool)
            here[row[p[: len(near)][near]]] = True
            here = (k > 0) & here[row[pos]]
            p, gx, k = pos[here], x[here], k[here]
            order = np.lexsort((p, gx))
            p, gx, k = p[order], gx[order], k[order]
            j = np.arange(len(p)) - k
            before = np.where((j >= 0) & (gx[np.maximum(j, 0)] == gx), p[np.maximum(j, 0)], -1)
            lo = np.maximum(np.maximum(before + 1, p - n + 1), first[row[p]])
            hi = np.minimum(p, first[row[p] + 1] - 1 - n)
            ok = hi >= lo
            step = np.bincount(lo[ok], minlength=len(g) + 1) - np.bincount(hi[ok] + 1, minlength=len(g) + 1)
            score = np.cumsum(step)
            a = np.flatnonzero(score >= need)
            found.append(np.stack([row[a], score[a], np.full(len(a), n), np.full(len(a), t), a]))
        if not found:
            return {}
        found = np.concatenate(found, axis=1)
        found = found[:, np.lexsort((found[4], found[3], found[2], -found[1], found[0]))]
        out = {}
        for r in np.unique(found[0]).tolist():
            lo, hi = np.searchsorted(found[0], [r, r + 1])
            a, z = first[r], first[r + 1]
            found[4, lo:hi] -= a
            out[r] = (s[a:z] - off[r], e[a:z] - off[r], found[1:, lo:hi].T.tolist())
        return out

    def scan(self, data: bytes, windows=None):
        """Matches (licence, template, dice, first byte, bytes) of lines, paragraphs of several lines, the whole text, and windows.

        Of windows that overlap, the one that shares most counts, and none where a line,
        paragraph or whole text that it overlaps shares as much.
        """
        out, at, para, lines = [], 0, 0, 0
        units = []
        for line in data.split(b"\n"):
            if line.strip():
                units.append((at, at + len(line)))
                lines += 1
            else:
                if lines > 1:
                    units.append((para, at - 1))
                lines = 0
            at += len(line) + 1
            if not line.strip():
                para = at
        if lines > 1:
            units.append((para, len(data)))
        if len(data) and (0, len(data)) not in units:
            units.append((0, len(data)))
        level = np.zeros(len(windows[0]) if windows else 0, np.int64)
        for a, z in units:
            if got := self.best(data[a:z]):
                name, i, *_ = self.known[got[1]]
                out.append((name, i, got[0], a, z - a))
                if windows:
                    p, q = np.searchsorted(windows[0], [a, z])
                    level[p:q] = np.maximum(level[p:q], got[2])
        for shared, n, t, w in windows[2] if windows else ():
            if level[w : w + n + 1].max() < shared:
                level[w : w + n + 1] = 2**62
                a, z = int(windows[0][w]), int(windows[1][w + n])
                out.append((*self.known[t][:2], shared / n, a, z - a))
        return out


MATCH = T.ArrayType(T.StructType([T.StructField("licence", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("dice", T.DoubleType()), T.StructField("first_byte", T.LongType()), T.StructField("n_bytes", T.LongType())]))


def scan(docs: DataFrame, templates=TEMPLATES, cut=CUT) -> DataFrame:
    """docs with `matches`; all rows and columns are kept. Null and empty texts have none. Each row is judged alone, so repeated rows and ids do not matter; a column of docs named matches gives way; an empty table stays empty."""
    import pyarrow as pa

    docs = docs.drop("matches")
    at = docs.columns.index("text")
    kind = pa.list_(pa.struct([("licence", pa.string()), ("template", pa.int32()), ("dice", pa.float64()), ("first_byte", pa.int64()), ("n_bytes", pa.int64())]))

    def run(batches):
        scanner = Scanner(templates, cut)
        for b in batches:
            buf, off = text_buffer(b.column(at))
            raw, found, cut_at = buf.tobytes(), [], 0
            while cut_at < len(off) - 1:  # a shard has about 8 MB
                end = max(cut_at + 1, int(np.searchsorted(off, off[cut_at] + (8 << 20), side="right")) - 1)
                windows = scanner.windows(buf[off[cut_at] : off[end]], off[cut_at : end + 1] - off[cut_at])
                for r in range(cut_at, end):
                    found.append([dict(zip(("licence", "template", "dice", "first_byte", "n_bytes"), m)) for m in scanner.scan(raw[off[r] : off[r + 1]], windows.get(r - cut_at))])
                cut_at = end
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "matches"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("matches", MATCH)]))


def op4(spark, sf_dir):
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    best = F.try_element_at(F.sort_array(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["licence"].alias("l")))), F.lit(1))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    return out.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.array_join(names, ",").alias("licences"), best["l"].alias("best"), F.round(-best["d"], 9).alias("dice"))

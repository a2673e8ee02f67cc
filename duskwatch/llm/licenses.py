"""License scans: MinHash over overlapping text windows finds templates, exact containment verifies.

A text is the sequence of its five-word shingles, words being runs of ASCII letters and digits in
lower case. For a template of ``L`` shingles, windows of fixed length lie over the text, each a
stride after the last, so that every stretch of ``1.25 L`` shingles is inside one. A window and
the template are a candidate if they agree in one band of one MinHash value. A stretch that holds
four fifths of the template makes their similarity at least a known number, and the bands are so
many that such a pair is missed with a probability of at most one in a million. Candidates are
verified: some stretch of ``1.25 L`` shingles must hold four fifths of the distinct shingles of
the template. Many notices differ in a version only, so a shingle of a text speaks for one template:
the best held has it, and the others have to reach four fifths without it.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from duskwatch.llm.common import mix, shingles, slices, texts, word_hashes
from duskwatch.llm.license_texts import FULL_TEXTS

WORDS = 5
SHARE = (4, 5)
MISS = 1e-6
_CHUNK = 262_144

# Names of licenses and their notices. The SQL knows these only.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                     "License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the "
                "GNU General Public License as published by the Free Software Foundation, either version 3 of "
                "the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
            "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
            "in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
            "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
            "furnished to do so, subject to the following conditions:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy "
                "of the MPL was not distributed with this file, You can obtain one at"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def _gnu(name: str, thing: str, license_: str, version: str) -> list[tuple[str, str]]:
    """Notices of a GNU license: or any later version, that version only, and in one line."""
    given = (f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the "
             f"GNU {license_} as published by the Free Software Foundation")
    return [
        (name, f"{given}; either version {version} of the License, or (at your option) any later version."),
        (name, f"{given}; version {version} of the License."),
        (name, f"This {thing} is free software; you can redistribute it and/or modify it under the terms of the "
               f"GNU {license_} version {version} as published by the Free Software Foundation."),
        (name, f"This work is licensed under the GNU {license_}, version {version}."),
        (name, f"Licensed under the GNU {license_}, version {version}."),
        (name, f"Licensed under the GNU {license_} v{version}."),
    ]


_CC_PARTS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
             "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
             "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_CC_FORMS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _creative_commons() -> list[tuple[str, str]]:
    out = []
    for part, title in _CC_PARTS.items():
        for version, form in _CC_FORMS.items():
            name = f"CC-{part}-{version}"
            out += [(name, f"This work is licensed under a Creative Commons {title} {version} {form} License."),
                    (name, f"Licensed under the Creative Commons {title} {version} {form} License."),
                    (name, f"Licensed under CC {part} {version}."),
                    (name, f"This work is licensed under CC {part} {version}.")]
    return out


# Standard headers of further licenses and versions, and one-line forms.
NOTICES = [
    *_gnu("GPL-1.0", "program", "General Public License", "1"),
    *_gnu("GPL-2.0", "program", "General Public License", "2"),
    *_gnu("GPL-3.0", "program", "General Public License", "3"),
    *_gnu("LGPL-2.0", "library", "Library General Public License", "2"),
    *_gnu("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
    *_gnu("LGPL-3.0", "program", "Lesser General Public License", "3"),
    *_gnu("AGPL-3.0", "program", "Affero General Public License", "3"),
    *_creative_commons(),
    *[(name, f"{how} under the {title} License.") for how in ("Released", "Licensed", "Distributed")
      for name, title in (("MIT", "MIT"), ("ISC", "ISC"), ("BSD", "BSD"), ("Zlib", "zlib"), ("BSD-2-Clause", "BSD 2-Clause"),
                          ("BSD-3-Clause", "BSD 3-Clause"))],
    *[(f"Apache-{v}", f"{how} under the Apache License, Version {v}.") for how in ("Released", "Licensed", "Distributed")
      for v in ("1.1", "2.0")],
    *[(f"MPL-{v}", f"{how} under the Mozilla Public License, Version {v}.")
      for how in ("Released", "Licensed", "Distributed") for v in ("1.0", "1.1", "2.0")],
    *[(f"EPL-{v}", f"{how} under the Eclipse Public License, Version {v}.")
      for how in ("Released", "Licensed", "Distributed") for v in ("1.0", "2.0")],
    *[(f"MPL-{v}", f"The contents of this file are subject to the Mozilla Public License Version {v} (the "
                   "\"License\"); you may not use this file except in compliance with the License. You may obtain a "
                   "copy of the License at") for v in ("1.0", "1.1")],
    ("AFL-3.0", "Licensed under the Academic Free License version 3.0"),
    ("Artistic-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the "
                     "Artistic License 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
                "software and accompanying documentation covered by this license (the \"Software\") to use, "
                "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works "
                "of the Software, and to permit third-parties to whom the Software is furnished to do so"),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and "
                "neighboring rights to this software to the public domain worldwide. This software is distributed "
                "without any warranty."),
    ("CC0-1.0", "This work is licensed under the Creative Commons CC0 1.0 Universal License."),
    ("CC0-1.0", "This work is marked with CC0 1.0 Universal."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CDDL-1.0", "The contents of this file are subject to the terms of the Common Development and Distribution "
                 "License (the \"License\"). You may not use this file except in compliance with the License."),
    ("EPL-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License v1.0 which accompanies this distribution, and is available at"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                "License 2.0 which is available at"),
    ("EUPL-1.1", "Licensed under the EUPL, Version 1.1 or - as soon they will be approved by the European Commission - "
                 "subsequent versions of the EUPL (the \"Licence\");"),
    ("EUPL-1.2", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - "
                 "subsequent versions of the EUPL (the \"Licence\");"),
    *[(f"GFDL-{v}", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU "
                    f"Free Documentation License, Version {v} or any later version published by the Free Software "
                    "Foundation") for v in ("1.1", "1.2", "1.3")],
    ("OFL-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
    ("WTFPL", "This program is free software. It comes without any warranty, to the extent permitted by applicable "
              "law. You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To "
              "Public License, Version 2, as published by Sam Hocevar."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the "
             "authors be held liable for any damages arising from the use of this software. Permission is granted to "
             "anyone to use this software for any purpose, including commercial applications, and to alter it and "
             "redistribute it freely, subject to the following restrictions:"),
]
KNOWN = [*TEMPLATES, *[r for r in NOTICES if r not in TEMPLATES], *FULL_TEXTS]

# One byte for each code point: ASCII letters in lower case, digits, and blanks for all else.
_PLAIN = bytes(ord(chr(c).lower()) if chr(c).isascii() and chr(c).isalnum() else 32 for c in range(256))


def plain(text: str) -> bytes:
    return text.encode("latin-1", "replace").translate(_PLAIN)


class Template:
    """A notice: its shingles, the stretch it may be spread over, and its windows and bands."""

    def __init__(self, name: str, notice: str):
        self.name = name
        found = shingles(word_hashes(plain(notice).split()), WORDS)
        self.grams = np.unique(found)
        self.stretch = math.ceil(1.25 * len(found))
        self.stride = max(1, self.stretch // 4)
        self.window = self.stretch + self.stride
        self.least = -(-SHARE[0] * len(self.grams) // SHARE[1])
        similar = self.least / (self.window + len(self.grams) - self.least)
        self.bands = math.ceil(math.log(MISS) / math.log1p(-similar))


def templates(rows=KNOWN) -> list[Template]:
    return [Template(*r) for r in rows]


class Index:
    """The bands of all templates, by size of window, and which shingles occur in any of them."""

    def __init__(self, known: list[Template]):
        self.known = known
        most = max(t.bands for t in known)
        salts = mix(np.arange(1, 2 * most + 1, dtype=np.uint64))
        self.salts = [(salts[b], salts[most + b] | np.uint64(1)) for b in range(most)]
        alike: dict[tuple[int, int], list[int]] = {}
        for k, t in enumerate(known):
            alike.setdefault((t.window, t.stride), []).append(k)
        self.sizes = []
        for (window, stride), ks in sorted(alike.items()):
            held = np.unique(np.concatenate([known[k].grams for k in ks]))
            bands = []
            for b, (xor, times) in enumerate(self.salts):
                own = [k for k in ks if b < known[k].bands]
                if own:
                    bands.append((xor, times, own, np.array([((known[k].grams ^ xor) * times).min() for k in own])))
            self.sizes.append((window, stride, held, bands))
        self.grams = np.unique(np.concatenate([t.grams for t in known]))
        self.seen = np.zeros(1 << _SEEN_BITS, bool)
        self.seen[self.grams >> _SEEN_SHIFT] = True

    def occurrences(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of shingles that any template has, and these shingles."""
        places = np.flatnonzero(self.seen[grams >> _SEEN_SHIFT])
        own = grams[places]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        held = self.grams[at] == own
        return places[held], own[held]


_SEEN_BITS = 20
_SEEN_SHIFT = np.uint64(64 - _SEEN_BITS)


def candidates(grams: np.ndarray, index: Index) -> list[tuple[int, int]]:
    """(place, template) of the windows that share a MinHash value with a template.

    ``grams`` may hold the shingles of many texts one after the other. The MinHash of a window is
    one of its shingles, so windows without a shingle of any template of their size agree with
    none of them and are passed over.
    """
    places, own = index.occurrences(grams)
    found = set()
    for window, stride, held, bands in index.sizes:
        at = np.minimum(np.searchsorted(held, own), len(held) - 1)
        near = places[held[at] == own]
        if not len(near):
            continue
        steps = np.arange(-(-window // stride) + 1)
        starts = (near // stride)[:, None] - steps
        starts = np.unique(starts[(starts >= 0) & (starts * stride + window > near[:, None])]) * stride
        for a in range(0, len(starts), max(1, _CHUNK // window)):
            own_starts = starts[a : a + max(1, _CHUNK // window)]
            ends = np.minimum(own_starts + window, len(grams))
            sizes = ends - own_starts
            offsets = np.cumsum(sizes) - sizes
            inside = grams[np.repeat(own_starts - offsets, sizes) + np.arange(sizes.sum())]
            for xor, times, ks, least in bands:
                minima = np.minimum.reduceat((inside ^ xor) * times, offsets)
                for hit in np.flatnonzero(least[:, None] == minima).tolist():
                    k, i = divmod(hit, len(minima))
                    found.add((int(own_starts[i]), ks[k]))
    return sorted(found)


def verify(grams: np.ndarray, regions: list[tuple[int, int]], t: Template, free=None) -> list[np.ndarray]:
    """Places of the shingles, each once, in stretches of one text that hold enough of the template.

    ``regions`` are overlapping windows of the text in order. Stretches are taken from the left
    and do not overlap. Only places marked in ``free`` count, if it is given.
    """
    out, at = [], 0
    merged: list[list[int]] = []
    for a, b in regions:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    for a, b in merged:
        held = np.isin(grams[a:b], t.grams)
        places = np.flatnonzero(held if free is None else held & free[a:b]) + a
        ends = np.searchsorted(places, places + t.stretch)
        for i in np.flatnonzero(ends - np.arange(len(places)) >= t.least):
            if places[i] < at:
                continue
            inside = places[i : ends[i]]
            first = np.sort(np.unique(grams[inside], return_index=True)[1])
            if len(first) >= t.least:
                out.append(inside[first])
                at = out[-1][-1] + 1
    return out


def settle(grams: np.ndarray, asked: dict[int, list[tuple[int, int]]], known: list[Template]) -> list[tuple[int, int, int]]:
    """(template, first, last shingle) in one text, where each place speaks for one template.

    Of stretches that share places the one that holds most shingles wins, then the one that holds
    the greater share, then the first in the list. Templates that lose places are verified again
    without them.
    """
    out, free = [], np.ones(len(grams), bool)
    while asked:
        stretches = [(-len(p), -len(p) / len(known[k].grams), k, p)
                     for k, regions in asked.items() for p in verify(grams, regions, known[k], free)]
        again = set()
        for _, _, k, places in sorted(stretches, key=lambda s: (*s[:3], s[3][0])):
            if free[places].all():
                free[places] = False
                out.append((k, int(places[0]), int(places[-1])))
            else:
                again.add(k)
        asked = {k: asked[k] for k in again}
    return out


def scan(batch_texts: list[str], known: list[Template] | Index) -> list[list[tuple[str, int, int]]]:
    """(license, start, end) in code points for each text."""
    index = known if isinstance(known, Index) else Index(known)
    known, clean = index.known, [plain(t) for t in batch_texts]
    grams = []
    for c in clean:
        words = c.split()
        grams.append(shingles(word_hashes(words), WORDS) if len(words) >= WORDS else np.zeros(0, np.uint64))
    out: list[list[tuple[str, int, int]]] = [[] for _ in clean]
    starts = np.cumsum([0, *map(len, grams)])
    if not starts[-1]:
        return out
    # A window belongs to every text it touches: it may begin in the one before.
    asked: dict[int, dict[int, list[tuple[int, int]]]] = {}
    for place, k in candidates(np.concatenate(grams), index):
        end = place + known[k].window
        i = int(np.searchsorted(starts, place, "right")) - 1
        while i < len(clean) and starts[i] < end:
            a, b = max(place, starts[i]) - starts[i], min(end, starts[i + 1]) - starts[i]
            if b > a:
                asked.setdefault(i, {}).setdefault(k, []).append((int(a), int(b)))
            i += 1
    for i, regions in asked.items():
        found = settle(grams[i], regions, known)
        if found:
            places = [m.span() for m in re.finditer(rb"[^ ]+", clean[i])]
            out[i] += [(known[k].name, places[a][0], places[b + WORDS - 1][1]) for k, a, b in found]
    return [sorted(spans, key=lambda s: (s[1], s[2], s[0])) for spans in out]


def findings(docs: DataFrame, rows=KNOWN) -> DataFrame:
    """One row for each document: doc_id, licenses (sorted distinct names), spans.

    A span has license, start and end (code points, end exclusive). Whole texts are read; a null
    or empty text, or one of fewer than five words, has none. Repeated rows are scanned alike,
    other columns are not read, and an empty table gives no rows.
    """
    span = pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        index = Index(templates(rows))
        for batch in slices(batches):
            found = scan(texts(batch, "text"), index)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 pa.array([sorted({s[0] for s in spans}) for spans in found], pa.list_(pa.string())),
                 pa.array([[dict(zip(("license", "start", "end"), s)) for s in spans] for spans in found],
                          pa.list_(span))], names=["doc_id", "licenses", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, licenses array<string>, spans array<struct<license string, start long, end long>>")


def oracle_sql() -> str:
    """The same verification over all places of all texts, as plain SQL."""
    listed = ", ".join(f"({k}, '{name}', '{notice}')" for k, (name, notice) in enumerate(TEMPLATES))
    return rf"""
with listed(k, license, notice) as (values {listed}),
known as (
    select k, license, unnest(range(1, len(w) - 3)) as i, w
    from (select k, license, regexp_extract_all(lower(notice), '[a-z0-9]+') as w from listed)
), grams as (
    select k, license, array_to_string(w[i : i + 4], ' ') as g, max(len(w) - 4) over (partition by k) as n
    from known
), bounds as (
    select k, license, ceil(1.25 * max(n)) as stretch, ceil(0.8 * count(distinct g)) as least
    from grams group by k, license
), words as (
    select doc_id, [lower(x) for x in regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+')] as w
    from documents
), placed as (
    select doc_id, i, array_to_string(w[i : i + 4], ' ') as g
    from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from words where len(w) >= 5)
), hits as (
    select distinct p.doc_id, p.i, g.k, p.g from placed p join grams g on p.g = g.g
), held as (
    select a.doc_id, a.k, a.i, count(distinct b.g) as held
    from hits a join bounds t on a.k = t.k
    join hits b on a.doc_id = b.doc_id and a.k = b.k and b.i >= a.i and b.i < a.i + t.stretch
    group by all
), matched as (
    select distinct h.doc_id, t.license from held h join bounds t on h.k = t.k where h.held >= t.least
)
select d.doc_id, coalesce(string_agg(m.license, ',' order by m.license), '') as licenses,
       count(m.license) as n_licenses
from documents d left join matched m on d.doc_id = m.doc_id group by d.doc_id
"""

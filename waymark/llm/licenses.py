"""Licence scans: a trained paragraph classifier, in DataFrame functions only when it scans.

A paragraph is a run of lines that hold words; marks of comments are no words. It is read through windows of 1, 2 and 4
of its lines, from every line on, so that a notice is seen whole whether it stands on one line or is wrapped, and
among other text. A window's features are its distinct lower-cased words and word pairs; a multinomial logistic
regression over the n-grams of the training paragraphs gives every family and an unknown class a probability. The
training paragraphs are made here from the families' notices (words dropped and put in, neighbours added, by a seeded
generator) and from prose that shares their words; the probabilities are calibrated by a temperature and the least
probability by a held-out part of them. A prediction counts once a template of that family confirms it: the window
holds the template's decisive words (versions among them) and at least CONFIRMED of its n-grams, or all of a template of up to
four words and little else. A window that holds one of DENIALS states no licence.
Of overlapping windows that say the same family, the smallest tells the line.

A window without a decisive word can't be confirmed, so only those with one are classified: this drops no finding.

Defined cases: null text is the empty text; rows may repeat, each gets its row; texts without a finding get empty
findings; extra columns are ignored; an empty table gives an empty result. Very long lines are scanned whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.llm.common import stage, text_column

#: Identifiers of licence families.
IDENTIFIERS = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv2"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv3"],
    "LGPL": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPLv3"], "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "AGPLv3"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "MPL-2.0": ["MPL-2.0"], "MPL-1.1": ["MPL-1.1"], "CC-BY-NC-4.0": ["CC-BY-NC-4.0"], "CC-BY-SA-4.0": ["CC-BY-SA-4.0"], "CC-BY-4.0": ["CC-BY-4.0"], "CC0": ["CC0-1.0"],
    "ISC": ["ISC"], "EPL-2.0": ["EPL-2.0"], "BSL-1.0": ["BSL-1.0"], "Unlicense": ["Unlicense"], "Zlib": ["Zlib"],
}
#: Sentences of notices, each with the words that decide, the rarest first.
NOTICES = {
    "MIT": [
        ("Released under the MIT License.", "license mit under"), ("Licensed under the MIT license", "license mit under"), ("This project is licensed under the terms of the MIT license", "license mit under"), ("The MIT License (MIT)", "license mit"),
        ("Distributed under the MIT licence", "licence mit under"), ("Dual licensed under the MIT and GPL licenses", "licenses mit licensed"), ("Available under the MIT license, see the LICENSE file for details", "license mit under"),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "hereby charge obtaining"),
        ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "substantial portions"),
    ],
    "Apache-2.0": [
        ("Licensed under the Apache License, Version 2.0.", "apache 2.0"), ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", "apache 2.0"),
        ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "www.apache.org"), ("This work is licensed under the Apache 2.0 license", "apache 2.0"),
        ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "apache 2.0"), ("Apache License Version 2.0, January 2004", "apache 2.0"),
    ],
    "GPL-2.0": [
        ("This work is licensed under the GNU General Public License, version 2.", "gnu general 2"), ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "gnu general 2"),
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "gnu general 2"),
        ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "gnu general 2"),
    ],
    "GPL-3.0": [
        ("This work is licensed under the GNU General Public License, version 3.", "gnu general 3"), ("GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gnu general 3"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation", "gnu general 3"),
        ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gnu general 3"),
    ],
    "LGPL": [
        ("Licensed under the GNU Lesser General Public License, version 2.1 or later.", "lesser gnu"), ("GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version", "lesser gnu"),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License", "lesser gnu"), ("Licensed under the GNU Lesser General Public License, version 3.", "lesser gnu"),
        ("GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "lesser gnu"), ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "lesser gnu"),
    ],
    "AGPL-3.0": [
        ("Licensed under the GNU Affero General Public License, version 3.", "affero gnu"), ("GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "affero gnu"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License", "affero gnu"),
        ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "affero gnu"),
    ],
    "BSD": [
        ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary"), ("Licensed under the BSD 3-Clause License.", "bsd"), ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "bsd-style"),
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "redistributions retain"), ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation", "redistributions reproduce"),
    ],
    "MPL-2.0": [("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "mozilla 2.0"), ("If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0", "mpl 2.0"), ("Mozilla Public License Version 2.0", "mozilla 2.0")],
    "MPL-1.1": [("The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License", "mozilla 1.1"), ("Mozilla Public License Version 1.1", "mozilla 1.1")],
    "CC-BY-NC-4.0": [("Licensed under CC BY-NC 4.0.", "by-nc cc"), ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "attribution-noncommercial creative 4.0")],
    "CC-BY-SA-4.0": [("Licensed under CC BY-SA 4.0.", "by-sa cc"), ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "attribution-sharealike creative 4.0")],
    "CC-BY-4.0": [("Licensed under CC BY 4.0.", "4.0 cc by"), ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "attribution creative 4.0")],
    "CC0": [("To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0.", "cc0 waived"), ("This work is dedicated to the public domain, CC0 1.0 Universal license.", "cc0 1.0")],
    "ISC": [("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "hereby fee"), ("Licensed under the ISC License", "license isc")],
    "EPL-2.0": [("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "eclipse public")],
    "BSL-1.0": [("Distributed under the Boost Software License, Version 1.0.", "license boost")],
    "Unlicense": [("This is free and unencumbered software released into the public domain.", "unencumbered")],
    "Zlib": [("This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software", "as-is liable authors"), ("Licensed under the zlib license", "license zlib")],
}
#: Prose with the same words that states no licence.
PROSE = [
    "The driver must carry a valid license at all times", "Our restaurant renewed its liquor license in version two of the form", "Students at MIT released a paper under review", "The general public was free to use the work",
    "Apache helicopters flew over version two of the base", "All rights reserved by the copyright holder of this film", "The license fee for this work rose by four percent", "Permission to enter the building is granted by the guard",
    "A copy of the contract is subject to the terms below", "The warranty does not cover damage from use", "Redistribution of land was the source of the conflict", "Creative work and common sense", "The software is expensive and needs a commercial license from the vendor",
    "He lost his fishing license near the public lake", "This license plate belongs to an unknown car", "Copyright law differs between countries", "The gnu grazed on the general plain at noon, two or three of them", "I hereby declare the meeting open to the public", "The lesser evil was chosen by the foundation",
    "Send me a cc of the letter by 4 o'clock", "The eclipse was public knowledge", "A boost in sales of version one", "MIT and other schools publish their source data", "The binary star system and the redistribution of mass", "Copyright 2020 by the author. All rights reserved.",
    "Portions of the text were substantial and without error", "We retain the right to reproduce this picture", "The Mozilla team spoke in public about the browser", "No part of this book may be copied without written permission of the publisher", "You must accept the license agreement before you install this program",
    "The law was waived for the author of the work", "Terms of use apply to this site and to the public pages", "The library is free and open at noon for all persons", "The creative director gave the attribution to her team", "An unencumbered estate was sold with a zlib of the key", "The compression library zlib is used by many programs",
    "The MIT license office issued a license for parking", "She compared the MIT license with others in her talk", "A lawyer explained what the Apache License means for firms", "The history of the GNU General Public License is told in chapter three", "Many people have read the BSD license and few understood it",
    "A license plate of the MIT car pool", "The Mozilla Public License was discussed at the meeting", "Creative Commons was founded in the year of the snake", "Which license is better, MIT or GPL, was asked in the forum", "The course covers the MIT license, patents and trade marks",
]
#: Short notices, and the word that makes a name in them one of a licence.
SHORT = {"SPDX-License-Identifier: {}": "spdx-license-identifier", "License: {}": "license", "{} License": "license", "Licensed under {}": "licensed"}
#: Word pairs that deny a notice in the same window.
DENIALS = ("not released", "not licensed", "not covered", "not under", "never released", "never licensed", "longer licensed", "longer released", "neither licensed", "neither released")
#: A name of up to four words is confirmed in windows with at most so many n-grams beside it.
BESIDE = 8
TOKEN = r"[a-z0-9]+(?:[.\-+][a-z0-9]+)*"
UNKNOWN = "unknown"
SPANS = (1, 2, 4)
VARIANTS, SEED, STEPS, PENALTY = 14, 11, 160, 1e-4
CONFIRMED = 0.6
#: Weights are whole multiples of one over this, so that their sums are exact in any order.
GRAIN = 4096


def words_in(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


def grams(text: str) -> list[str]:
    return grams_of(words_in(text))


def grams_of(words: list[str]) -> list[str]:
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))})


@dataclass(frozen=True)
class Template:
    family: str
    text: str
    decisive: tuple[str, ...]

    @property
    def needed(self) -> int:
        """How many of the n-grams a window must hold."""
        n = len(grams(self.text))
        return n if self.short else -(-int(n * CONFIRMED * 1000) // 1000)

    @property
    def short(self) -> bool:
        return len(words_in(self.text)) <= 4

    @property
    def most(self) -> int:
        """How many n-grams a window may have: a short name in a long sentence is talk about a licence."""
        return len(grams(self.text)) + BESIDE if self.short else 1_000_000


def templates() -> list[Template]:
    out = [Template(f, text, tuple(words.split())) for f, notices in NOTICES.items() for text, words in notices]
    for family, names in IDENTIFIERS.items():
        for name in names:
            rare = any(c.isdigit() for c in name)  # other names are words of some language, and need the word beside them
            out += [Template(family, form.format(name), (name.lower(),) if rare else (word, name.lower())) for form, word in SHORT.items()]
            out += [Template(family, name, (name.lower(),))] if "-" in name or name.startswith(("GPL", "LGPL", "AGPL")) else []
    return out


TEMPLATES = templates()
for t in TEMPLATES:
    assert set(t.decisive) <= set(words_in(t.text)), t
ANCHORS = sorted({t.decisive[0] for t in TEMPLATES})
#: Whatever holds a decisive word as a token matches this, lower-cased.
ANCHOR = "(?:^|[^a-z0-9])(?:" + "|".join(a.replace(".", r"\.").replace("+", r"\+") for a in ANCHORS) + ")"


@dataclass
class Model:
    families: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float


def training_paragraphs(rng: np.random.Generator) -> list[tuple[str, str]]:
    filler = sorted({w for p in PROSE for w in p.lower().split()})
    pick = lambda x: x[int(rng.integers(0, len(x)))]

    def varied(text: str, most_dropped: float, keep: tuple[str, ...] = ()) -> str:
        words = [w for w in text.split() if rng.random() > most_dropped * rng.random() or set(words_in(w)) & set(keep)]
        for _ in range(int(rng.integers(0, 4))):
            words.insert(int(rng.integers(0, len(words) + 1)), pick(filler))
        return " ".join(words)

    def among(text: str) -> str:
        """Alone, or with a line before it or behind it."""
        place = rng.integers(0, 5)
        return f"{varied(pick(PROSE), 0.4)} {text}" if place == 0 else f"{text} {varied(pick(PROSE), 0.4)}" if place == 1 else text

    rows = []
    for t in TEMPLATES:
        short = t.short
        rows += [(t.family, among(t.text if short else varied(t.text, 0.2, t.decisive))) for _ in range(VARIANTS // (2 if short else 1))]
        rows += [(t.family, t.text)] * 3
    for family, notices in NOTICES.items():
        rows += [(family, " ".join(n for n, _ in notices[i : i + 2])) for i in range(len(notices) - 1)] * 3
    rows += [(UNKNOWN, varied(p, 0.4)) for p in PROSE for _ in range(2 * VARIANTS)]
    rows += [(UNKNOWN, f"{varied(pick(PROSE), 0.4)} {varied(pick(PROSE), 0.4)}") for _ in range(10 * VARIANTS)]
    everything = [w for x in [*(t.text for t in TEMPLATES if not t.short), *PROSE] for w in x.split()]
    rows += [(UNKNOWN, " ".join(rng.choice(everything, int(rng.integers(3, 20))))) for _ in range(20 * VARIANTS)]
    return rows


def fit(seed: int = SEED) -> Model:
    """The regression by gradient steps, then temperature and least probability on a held-out fifth."""
    rng = np.random.default_rng(seed)
    rows = training_paragraphs(rng)
    rows = [rows[i] for i in rng.permutation(len(rows))]
    families = [*NOTICES, UNKNOWN]
    counted: dict[str, int] = {}
    found = [grams(text) for _, text in rows]
    for of in found:
        for g in of:
            counted[g] = counted.get(g, 0) + 1
    vocabulary = {g: i for i, g in enumerate(sorted(g for g, c in counted.items() if c >= 5))}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for i, of in enumerate(found):
        x[i, [vocabulary[g] for g in of if g in vocabulary]] = 1
    y = np.zeros((len(rows), len(families)), np.float32)
    y[np.arange(len(rows)), [families.index(f) for f, _ in rows]] = 1
    cut = len(rows) * 4 // 5
    w, b = np.zeros((len(vocabulary), len(families)), np.float32), np.zeros(len(families), np.float32)
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(STEPS):
        z = x[:cut] @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - y[:cut]) / cut
        mw, mb = 0.9 * mw + x[:cut].T @ g + PENALTY * w, 0.9 * mb + g.sum(axis=0)
        w, b = w - 4.0 * mw, b - 4.0 * mb
    w[np.abs(w) < 0.03] = 0  # sparse
    w, b = np.round(w.astype(float) * GRAIN) / GRAIN, np.round(b.astype(float) * GRAIN) / GRAIN
    z, truth = x[cut:] @ w + b, y[cut:].argmax(axis=1)

    def softmax(t: float) -> np.ndarray:
        p = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return p / p.sum(axis=1, keepdims=True)

    temperature = min(np.geomspace(0.25, 4, 33), key=lambda t: -np.log(softmax(t)[np.arange(len(truth)), truth] + 1e-12).mean())
    wrong = softmax(temperature)[:, :-1].max(axis=1)[truth == len(families) - 1]
    least = float(np.clip(np.quantile(wrong, 0.99), 0.5, 0.9))
    used, names = np.flatnonzero(np.abs(w).sum(axis=1)), list(vocabulary)
    return Model(families, {names[i]: j for j, i in enumerate(used)}, w[used], b, float(temperature), least)


_models: dict[int, Model] = {}


def model(seed: int = SEED) -> Model:
    if seed not in _models:
        _models[seed] = fit(seed)
    return _models[seed]


def shared_grams() -> list[tuple[str, int, int]]:
    """(gram, template, 1 if it decides)"""
    return [(g, i, int(g in t.decisive)) for i, t in enumerate(TEMPLATES) for g in grams(t.text)]


def tables(spark: SparkSession, m: Model) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(gram, w), (gram, template, decides) and (template, family, needed, most, decisive): a few thousand rows, fixed above."""
    weights = spark.createDataFrame([(g, m.weights[i].tolist()) for g, i in m.vocabulary.items()], "gram string, w array<double>")
    shares = spark.createDataFrame(shared_grams(), "gram string, template int, decides int")
    return weights, shares, spark.createDataFrame([(i, t.family, t.needed, t.most, len(t.decisive)) for i, t in enumerate(TEMPLATES)], "template int, family string, needed int, most int, decisive int")


def window_grams(words: Column) -> Column:
    pairs = F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.array_compact(F.concat(words, pairs)))


def windows(texts: DataFrame) -> DataFrame:
    """texts(uid, text) -> (uid, line, span, words) of the windows that hold a decisive word. Each line brings the next
    ones of its paragraph along, so a text of any length is taken apart in proportion to it."""
    longest = max(SPANS)
    lines = F.transform(F.split(F.lower("text"), "\n", -1), lambda x: F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)))
    anchors = F.array(*(F.lit(a) for a in ANCHORS))
    ahead = texts.select("uid", lines.alias("lines")).select("uid", F.posexplode(F.transform("lines", lambda x, i: F.slice(F.col("lines"), i + 1, longest))).alias("line", "ahead"))
    ahead = ahead.filter(F.arrays_overlap(F.flatten("ahead"), anchors))
    blank = F.array_position(F.transform("ahead", lambda x: F.size(x) == 0), True).cast("int")
    ahead = ahead.withColumn("run", F.when(blank > 0, blank - 1).otherwise(F.size("ahead")))
    spans = F.array_distinct(F.array(*(F.least(F.lit(s), F.col("run")) for s in SPANS)))
    found = ahead.filter("run > 0").select("uid", "line", "ahead", F.explode(spans).alias("span"))
    return found.select("uid", "line", "span", F.flatten(F.slice("ahead", 1, F.col("span"))).alias("words")).filter(F.arrays_overlap("words", anchors))


def scan(docs: DataFrame, m: Model | None = None) -> DataFrame:
    """doc_id and found, an array of (line, family, probability), for every row of docs."""
    spark, m = docs.sparkSession, m or model()
    weights, shares, needed = tables(spark, m)
    text = text_column()
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), F.when(F.lower(text).rlike(ANCHOR), text).alias("text"))
    rows = stage(rows, "licences")
    found = windows(rows.filter("text is not null")).select("uid", "line", "span", window_grams(F.col("words")).alias("grams"))
    found = found.filter(~F.arrays_overlap("grams", F.array(*(F.lit(d) for d in DENIALS))))
    features = stage(found.select("uid", "line", "span", F.size("grams").alias("size"), F.explode("grams").alias("gram")), "grams")
    key = ["uid", "line", "span"]
    sums = [F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(len(m.families))]
    logits = features.join(F.broadcast(weights), "gram").groupBy(*key).agg(*sums)
    z = F.array(*((F.col(f"z{i}") + float(b)) / m.temperature for i, b in enumerate(m.bias)))
    scored = logits.withColumn("z", z).withColumn("top", F.array_max("z")).withColumn("total", F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top"))))
    families = F.array(*(F.lit(f) for f in m.families))
    scored = scored.select(*key, families[F.array_position("z", F.col("top")).cast("int") - 1].alias("family"), (1 / F.col("total")).alias("probability"))
    scored = scored.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= m.least))
    held = features.join(F.broadcast(shares), "gram").groupBy(*key, "template").agg(F.count("*").alias("n"), F.sum("decides").alias("decided"), F.first("size").alias("size"))
    sure = held.join(F.broadcast(needed), "template").filter((F.col("n") >= F.col("needed")) & (F.col("size") <= F.col("most")) & (F.col("decided") >= F.col("decisive")))
    confirmed = scored.join(sure.select(*key, "family"), [*key, "family"], "left_semi")
    by_start = Window.partitionBy("uid", "family").orderBy("line", "span")
    reach = F.max(F.col("line") + F.col("span")).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("line") < reach, 0).otherwise(1)
    island = confirmed.withColumn("new", new).withColumn("island", F.sum("new").over(by_start.rowsBetween(Window.unboundedPreceding, 0)))
    best = island.groupBy("uid", "family", "island").agg(F.min(F.struct("span", "line", "probability")).alias("b")).select("uid", "family", "b.line", "b.probability")
    by_row = best.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("line", "family", "probability"))).alias("found"))
    nothing = F.array().cast("array<struct<line:int,family:string,probability:double>>")
    return rows.select("uid", "doc_id").join(by_row, "uid", "left").select("doc_id", F.coalesce("found", nothing).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_found, licenses (distinct families, comma-joined), lines (line:family, comma-joined)."""
    return scanned.select(
        "doc_id", F.size("found").cast("long").alias("n_found"), F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"])))).alias("licenses"),
        F.concat_ws(",", F.transform("found", lambda x: F.concat_ws(":", x["line"].cast("string"), x["family"]))).alias("lines"),
    )


def oracle_sql(m: Model | None = None, docs: str = "documents") -> str:
    """digest(scan()) in DuckDB's SQL, with the fitted weights written out."""
    m = m or model()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    names = [f"z{i}" for i in range(len(m.families))]
    weights = ", ".join(f"({quoted(g)}, {', '.join(repr(float(v)) + '::DOUBLE' for v in m.weights[i])})" for g, i in m.vocabulary.items())
    shares = ", ".join(f"({quoted(g)}, {t}, {d})" for g, t, d in shared_grams())
    needed = ", ".join(f"({i}, {quoted(t.family)}, {t.needed}, {t.most}, {len(t.decisive)})" for i, t in enumerate(TEMPLATES))
    sums = ", ".join(f"(sum({z}) + {float(b)!r}) / {m.temperature!r} AS {z}" for z, b in zip(names, m.bias, strict=True))
    family = "CASE " + " ".join(f"WHEN {z} = top THEN {quoted(f)}" for z, f in zip(names, m.families, strict=True)) + " END"
    anchors, denials = ("[" + ", ".join(map(quoted, x)) + "]" for x in (ANCHORS, DENIALS))
    return f"""WITH weights(gram, {", ".join(names)}) AS (VALUES {weights}), shares(gram, template, decides) AS (VALUES {shares}), needed(template, family, needed, most, decisive) AS (VALUES {needed}),
d AS (SELECT doc_id, row_number() OVER () AS uid, coalesce(text, '') AS text FROM {docs}), l AS (SELECT uid, list_transform(string_split(lower(text), chr(10)), lambda x: regexp_extract_all(x, '{TOKEN}')) AS lines FROM d WHERE regexp_matches(lower(text), '{ANCHOR}')),
a AS (SELECT uid, i AS line, lines[i + 1:i + {max(SPANS)}] AS ahead FROM (SELECT uid, lines, unnest(range(0, len(lines))) AS i FROM l)),
r AS (SELECT *, coalesce(list_position(list_transform(ahead, lambda x: len(x) = 0), true) - 1, len(ahead)) AS run FROM a),
w AS (SELECT DISTINCT uid, line, least(s.span, run) AS span, flatten(ahead[1:least(s.span, run)]) AS words FROM r, (VALUES {", ".join(f"({s})" for s in SPANS)}) AS s(span) WHERE run > 0),
gs AS (SELECT uid, line, span, list_distinct(list_concat(words, list_transform(range(1, len(words)), lambda k: words[k] || ' ' || words[k + 1]))) AS grams FROM w WHERE list_has_any(words, {anchors})),
g AS (SELECT uid, line, span, len(grams) AS size, unnest(grams) AS gram FROM gs WHERE NOT list_has_any(grams, {denials})),
z AS (SELECT uid, line, span, {sums} FROM g JOIN weights USING (gram) GROUP BY uid, line, span), y AS (SELECT *, greatest({", ".join(names)}) AS top FROM z),
f AS (SELECT uid, line, span, {family} AS family, 1 / ({" + ".join(f"exp({z} - top)" for z in names)}) AS probability FROM y),
s AS (SELECT DISTINCT uid, line, span, family FROM (SELECT uid, line, span, template, size, count(*) AS n, sum(decides) AS decided FROM g JOIN shares USING (gram) GROUP BY ALL) JOIN needed USING (template) WHERE n >= needed AND size <= most AND decided >= decisive),
c AS (SELECT uid, line, span, family FROM f JOIN s USING (uid, line, span, family) WHERE family <> '{UNKNOWN}' AND probability >= {m.least!r}),
n AS (SELECT *, CASE WHEN line < max(line + span) OVER (PARTITION BY uid, family ORDER BY line, span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM c),
i AS (SELECT *, sum(new) OVER (PARTITION BY uid, family ORDER BY line, span ROWS UNBOUNDED PRECEDING) AS island FROM n),
b AS (SELECT uid, family, island, arg_min(line, span * 1000000000 + line) AS line FROM i GROUP BY ALL),
t AS (SELECT uid, count(*) AS n_found, string_agg(DISTINCT family, ',' ORDER BY family) AS licenses, string_agg(line || ':' || family, ',' ORDER BY line, family) AS lines FROM b GROUP BY uid)
SELECT doc_id, coalesce(n_found, 0) AS n_found, coalesce(licenses, '') AS licenses, coalesce(lines, '') AS lines FROM d LEFT JOIN t USING (uid)"""

import math
import re
from collections import Counter

import pytest

from waymark.llm import licenses

MIT = """Copyright (c) 2019 Somebody Else

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software"""
BSD = """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions are met:
#"""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""
GPL2 = GPL.replace("version 3", "version 2").replace("software: you", "software; you")
APACHE = """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at"""
AGPL = GPL.replace("GNU General", "GNU Affero General")
#: Text, its family and the line on which it is to be found; none of them is a template.
CASES = {
    "Released under the MIT License.": "0:MIT", "This work is licensed under the GNU General Public License, version 3.": "0:GPL-3.0", "Licensed under CC BY-NC 4.0.": "0:CC-BY-NC-4.0", "// Licensed under the Apache License, Version 2.0 (the rest)": "0:Apache-2.0",
    "SPDX-License-Identifier: BSD-3-Clause": "0:BSD", "SPDX-License-Identifier: GPL-2.0-only": "0:GPL-2.0", "MIT License": "0:MIT", "License: MIT": "0:MIT", "GPL-3.0": "0:GPL-3.0",
    "Licensed under the GNU General Public License, version 2.": "0:GPL-2.0", "Licensed under the GNU Affero General Public License, version 3.": "0:AGPL-3.0", "This is licensed under the GNU Lesser General Public License, version 2.1": "0:LGPL",
    MIT: "MIT", BSD: "BSD", GPL: "GPL-3.0", GPL2: "GPL-2.0", APACHE: "Apache-2.0", AGPL: "AGPL-3.0",
    "The license plate of the car was unknown to the guard": "", "MIT is a school": "", "Copyright is a matter of law in most countries of the world": "", "": "", "All rights reserved. No license is granted.": "",
    "The MIT license office issued a license for parking.": "", "This is not released under the MIT License.": "", "Creative Commons Attribution 3.0 Unported License": "", "This work is licensed under a Creative Commons Attribution 3.0 Unported License.": "", "The firm is no longer licensed under the Apache License, Version 2.0.": "",
    "We read the MIT license aloud and then went home to our families": "", "The GNU General Public License was much discussed at the meeting of the board": "",
    "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991": "GPL-2.0", "Apache License\nVersion 2.0, January 2004": "Apache-2.0", "distributed under the MIT licence": "MIT", "Dual licensed under the MIT and GPL licenses": "MIT",
    "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\")": "MPL-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "MPL-2.0", "GNU AFFERO GENERAL PUBLIC LICENSE\nVersion 3, 19 November 2007": "AGPL-3.0",
    "He sent a cc by mail to the creative director": "", "The gnu public met the general": "",
}


def brute(text, m):
    """The same model without Spark."""
    lines = [licenses.words_in(x) for x in (text or "").split("\n")]
    found = []
    for i in range(len(lines)):
        run = next((k for k, x in enumerate(lines[i : i + 4]) if not x), len(lines[i : i + 4]))
        for span in sorted({min(s, run) for s in licenses.SPANS}) if run else ():
            words = sum(lines[i : i + span], [])
            have = set(licenses.grams_of(words))
            if not have & set(licenses.ANCHORS) or have & set(licenses.DENIALS) or not (known := [m.vocabulary[g] for g in have if g in m.vocabulary]):
                continue
            z = (m.weights[known].sum(axis=0) + m.bias) / m.temperature
            best = int(z.argmax())
            sure = {t.family for t in licenses.TEMPLATES if sum(g in have for g in licenses.grams(t.text)) >= t.needed and len(have) <= t.most and set(t.decisive) <= have}
            if m.families[best] in sure and 1 / sum(math.exp(v - z[best]) for v in z) >= m.least:
                found.append((m.families[best], i, span))
    out = []
    for family in sorted({f for f, _, _ in found}):
        islands, reach = [], -1
        for _, line, span in sorted(x for x in found if x[0] == family):
            islands += [[]] if line >= reach else []
            islands[-1].append((span, line))
            reach = max(reach, line + span)
        out += [(min(x)[1], family) for x in islands]
    return ",".join(f"{line}:{family}" for line, family in sorted(out))


@pytest.mark.parametrize("text", CASES)
def test_families(text):
    got, want = brute(text, licenses.model()), CASES[text]
    assert got == want if not want or ":" in want else {x.split(":")[1] for x in got.split(",")} == {want}


def test_a_notice_among_other_lines():
    m = licenses.model()
    for text, want in ((MIT, "MIT"), (BSD, "BSD"), (GPL, "GPL-3.0"), (APACHE, "Apache-2.0")):
        got = brute("some prose of the river\nand the stone\n" + text + "\n\nmore prose\nfor the end", m)
        assert {x.split(":")[1] for x in got.split(",")} == {want}


def test_nothing_decisive_is_filtered():
    """Every template passes the filter of texts, in any case and behind any mark."""
    for t in licenses.TEMPLATES:
        for text in (t.text, "x\n(" + t.text.upper() + ")"):
            assert re.search(licenses.ANCHOR, text.lower())


def cases(texts):
    return texts + [(10**6 + i, "x y\n" + t + "\nz") for i, t in enumerate(CASES)] + [(10**7 + i, "x\n\n" + t + "\n\n" + t) for i, t in enumerate(CASES)]


def test_against_brute_force(spark, texts, odd):
    m = licenses.model()
    for df in (spark.createDataFrame(cases(texts), "doc_id long, text string"), odd):
        want = Counter((r["doc_id"], brute(r["text"], m)) for r in df.collect())
        rows = licenses.digest(licenses.scan(df)).collect()
        assert Counter((r["doc_id"], r["lines"]) for r in rows) == want
        assert all(r["n_found"] == len([x for x in r["lines"].split(",") if x]) for r in rows)


def test_sql_says_the_same(texts):
    import duckdb
    import pandas as pd

    m = licenses.model()
    rows = [*cases(texts), (-1, None)]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    got = {r[0]: r[3] for r in con.execute(licenses.oracle_sql(m)).fetchall()}
    assert got == {d: brute(t, m) for d, t in rows}


def test_empty(none):
    assert licenses.digest(licenses.scan(none)).collect() == []

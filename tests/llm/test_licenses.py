from __future__ import annotations

from logloom.llm import licenses
from logloom.llm.queries import ORACLE, QUERIES
from tests.llm.helpers import clashing, documents
from tests.oracle_check import compare, duck

MIT, GPL, APACHE = (licenses.TEMPLATES[k] for k in ("MIT", "GPL-3.0", "Apache-2.0"))
FILES = [
    (1, "a/LICENSE", MIT), (2, "a/x.py", "code"), (3, "a/b/c/y.py", "more\ncode"), (4, "a/b/COPYING.txt", "intro\n" + GPL), (5, "a/b/c/d/z.py", None),
    (6, "a/w.py", "x\n# " + APACHE.upper() + "\ny"), (7, "q.py", ""), (8, None, "no path"), (9, "a/b/NOTICE", "Copyright somebody else entirely, all rights"),
    (10, "ab/v.py", "text"), (11, "c/LICENSE", MIT), (11, "c/LICENSE", MIT), (12, "c/LICENCE", APACHE), (13, "c/u", "license " * 3), (None, "c/t", "t"),
]


def test_inheritance(spark):
    df = clashing(spark.createDataFrame(FILES, "doc_id bigint, path string, text string")).repartition(3)
    got = sorted(((r.doc_id or 0, r.license, r.origin, r.licence_path) for r in licenses.license_scan(df).collect()), key=str)
    assert got == sorted([
        (0, "Apache-2.0", "inherited", "c/LICENCE"), (1, "MIT", "own", None), (2, "MIT", "inherited", "a/LICENSE"), (3, "GPL-3.0", "inherited", "a/b/COPYING.txt"),
        (4, "GPL-3.0", "own", None), (5, "GPL-3.0", "inherited", "a/b/COPYING.txt"), (6, "Apache-2.0", "own", None), (7, None, "none", None),
        (8, None, "none", None), (9, "GPL-3.0", "inherited", "a/b/COPYING.txt"), (10, None, "none", None), (11, "MIT", "own", None), (11, "MIT", "own", None),
        (12, "Apache-2.0", "own", None), (13, "Apache-2.0", "inherited", "c/LICENCE"),
    ], key=str)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(spark, duck(folder), "op5", QUERIES["op5_licenses"], ORACLE["op5_licenses"], folder) is None


def test_empty(spark):
    assert licenses.license_scan(licenses.as_files(documents(spark, []))).count() == 0
    got = licenses.license_scan(licenses.as_files(documents(spark, [(1, None, None), (2, "Released under the MIT License.\nx", None)]))).collect()
    assert sorted((r.doc_id, r.license, r.origin) for r in got) == [(1, "MIT", "inherited"), (2, "MIT", "own")]


HEADERS = {
    "# SPDX-License-Identifier: MIT\nimport os\n": "MIT", "// SPDX-License-Identifier: GPL-2.0-or-later\nint x;": "GPL-2.0", "/* SPDX-License-Identifier: Zlib */\nint x;": None,
    "MIT License": "MIT", "x\nThis work is licensed under the GNU General Public License, version 2.\ny": "GPL-2.0",
    "Photo notes.\n\nThis work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0\nInternational License.": "CC-BY-NC-SA-4.0",
    # A header over several lines, none of which states the licence.
    "/*\n * calc, a desk calculator\n * Copyright (C) 2011 A. Person\n *\n * This library is free software: you can redistribute it and/or modify\n * it under the terms of the GNU Lesser General\n"
    " * Public License as published by\n * the Free Software Foundation, either version 3 of the\n * License, or (at your option) any later version.\n */\nint main;\n": "LGPL-3.0",
    "#!/bin/sh\n# Copyright 2019 The Tool Authors\n#\n# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or without fee is hereby granted, provided that the above\n"
    "# copyright notice and this permission notice appear in all copies.\necho\n": "ISC",
    "The permission to stay was granted by the council, and the warranty of the house went with it.": None,
}


def test_wordings_beyond_single_lines(spark):
    rows = [(k, f"d{k}/x.c", text) for k, text in enumerate(HEADERS)]
    wanted = dict(enumerate(HEADERS.values()))
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC-BY-SA-4.0"):
        k, text = len(rows), (licenses.TEXTS / f"{name}.txt").read_text()
        # Other holders, another line width and one passage left out.
        words = text.replace("Regents of the University of California", "Tool Authors").split()
        words = words[: len(words) // 2] + words[len(words) // 2 + 9:]
        rows.append((k, f"d{k}/COPYING", "\n".join(" ".join(words[i:i + 6]) for i in range(0, len(words), 6))))
        wanted[k] = name
    df = spark.createDataFrame(rows, "doc_id bigint, path string, text string")
    assert {r.doc_id: r.license for r in licenses.license_scan(df).collect()} == wanted

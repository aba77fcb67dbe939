"""Licenses with much text in common are told apart."""

from lakemill.llm.licenses import TEMPLATES, license_scan

GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
OPENING = next(t for n, t in TEMPLATES if n == "BSD")
CLAUSE = next(t for n, t in TEMPLATES if n == "BSD-3-Clause")
CASES = [
    ("Licensed under CC BY-NC 4.0.", {"CC-BY-NC-4.0"}),
    ("Licensed under CC BY-NC 4.0. Made by 4 people.", {"CC-BY-NC-4.0"}),
    ("Licensed under CC BY-SA 4.0.", {"CC-BY-SA-4.0"}),
    ("Licensed under CC BY 4.0.", {"CC-BY-4.0"}),
    ("Licensed under CC BY 4.0. Images: licensed under CC BY-NC 4.0.", {"CC-BY-4.0", "CC-BY-NC-4.0"}),
    ("Licensed under CC BY-NC-SA 4.0.", set()),
    (GNU.format("GNU General Public License", 3), {"GPL-3.0"}),
    (GNU.format("GNU General Public License", 2), {"GPL-2.0"}),
    (GNU.format("GNU Affero General Public License", 3), {"AGPL-3.0"}),
    (GNU.format("GNU Lesser General Public License", 3), {"LGPL-3.0"}),
    (GNU.format("GNU Affero General Public License", 2), set()),
    ("This work is licensed under the GNU General Public License, version 2.", {"GPL-2.0"}),
    ("This work is licensed under the GNU General Public License, version 4.", set()),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", {"MPL-2.0"}),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", set()),
    ("To the extent possible under law, the editors have waived all copyright and related or neighboring rights to this work.", {"CC0-1.0"}),
    ("This is free and unencumbered software released into the public domain.", {"Unlicense"}),
    (next(t for n, t in TEMPLATES if n == "ISC"), {"ISC"}),
    ("Licensed under the Apache License, Version 2.0.", {"Apache-2.0"}),
    (OPENING + " 1. Source code must retain the notice. 2. Binaries must reproduce it.", {"BSD"}),
    (OPENING + " 1. Source code must retain the notice. 3. " + CLAUSE, {"BSD", "BSD-3-Clause"}),
    ("They released under the bridge a boat. Some say the MIT crowd came. An MIT license debate followed.", set()),
    ("We released a boat under " + "some more words of a tale " * 40 + "the MIT crowd, and the MIT license was read.", set()),
    ("The MIT License (MIT) Copyright (c) 2020 Someone", {"MIT"}),
    ("Licensed under the Apache License 2.0", {"Apache-2.0"}),
    ("Licensed under the Apache License 1.1", set()),
    ("// SPDX-License-Identifier: GPL-2.0-or-later", {"GPL-2.0"}),
    ("# SPDX-License-Identifier: Apache-2.0", {"Apache-2.0"}),
    ("/* SPDX-License-Identifier: BSD-3-Clause */", {"BSD-3-Clause"}),
    ("SPDX-License-Identifier: MIT", {"MIT"}),
    ("SPDX-License-Identifier: WTFPL", set()),
    (next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 500), {"MIT"}),
]


def test_relatives(spark):
    table = spark.createDataFrame([(i, "Some words before it. " + t + " And after it.") for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    got = {i: set() for i in range(len(CASES))}
    for x in license_scan(table).collect():
        got[x["doc_id"]].add(x["license"])
    assert got == {i: want for i, (_, want) in enumerate(CASES)}


def test_recall_of_edited_notices(spark):
    """Notices with some words changed at random: of the pairs that brute force finds by containment and phrases, nearly all are found."""
    import random
    import re

    from lakemill.llm.licenses import DECIDING

    rng, split = random.Random(3), lambda t: re.findall(r"[^\W_]+", t.lower())
    pairs = lambda w: {tuple(w[i : i + 2]) for i in range(len(w) - 1)}
    texts = []
    for k in range(400):
        notice = split(TEMPLATES[k % len(TEMPLATES)][1])
        for _ in range(rng.randrange(3)):
            notice[rng.randrange(len(notice))] = f"edit{rng.randrange(1000)}"
        filler = lambda: [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(40))]
        texts.append(" ".join([*filler(), *notice, *filler()]))
    want = set()
    for i, text in enumerate(texts):
        words = split(text)
        for t, (name, notice) in enumerate(TEMPLATES):
            held = pairs(split(notice))
            phrases = [p for p in DECIDING.get(name, ()) if f" {p} " in f" {' '.join(split(notice))} "]
            if 100 * len(held & pairs(words)) >= 80 * len(held) and all(f" {p} " in f" {' '.join(words)} " for p in phrases):
                want.add((i, t))
    got = {(x["doc_id"], x["template"]) for x in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    print(len(want), len(want & got) / len(want))
    assert len(want) > 150 and got <= want and len(want & got) >= 0.95 * len(want)

from docs import ODD, clashing, frame, words

from relaypack.llm import licenses

PLANTED = {
    0: ("MIT", "Released under the MIT License."),
    1: ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    2: ("GPL", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published"),
    3: ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    4: ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    5: ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    6: ("Proprietary", "Copyright 2023 Some Corp. All rights reserved."),
    7: ("MPL", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    8: ("LGPL", "SPDX-License-Identifier: LGPL-2.1-only"),
    9: ("unknown", "He lost his driving license at the public house and asked for permission to redistribute the cookies."),
    10: ("unknown", "plain words about nothing"),
}


def rows():
    return [(i, f"{words(40, i)}\n{t}\n{words(30, 50 + i)}", "en", "s", 1) for i, (_, t) in PLANTED.items()]


def test_planted_families(spark):
    got = {r.doc_id: r for r in licenses.scan(spark, frame(spark, rows())).collect()}
    assert {i: r.license for i, r in got.items()} == {i: f for i, (f, _) in PLANTED.items()}
    assert all(r.n_paragraphs == 3 for r in got.values())


def test_paragraph_scores_equal_plain_python(spark):
    """The native form against the same model by hand."""
    import numpy as np

    m = licenses.fit()
    got = {(r.doc_id, r.place): r for r in licenses.paragraphs(spark, frame(spark, rows())).collect()}
    for d, text, *_ in rows():
        for place, line in enumerate(text.split("\n")):
            g = licenses.grams(line) & set(m.weights)
            z = (np.array(m.bias) + sum((np.array(m.weights[x]) for x in g), np.zeros(len(m.families)))) / m.temperature
            p = np.exp(z - z.max())
            p /= p.sum()
            sure = bool(g) and m.families[int(p.argmax())] != "unknown" and p.max() >= licenses.LEAST
            assert ((d, place) in got) == sure
            if sure:
                r = got[d, place]
                assert r.family == m.families[int(p.argmax())] and abs(r.probability - p.max()) < 1e-9
                cover = max(len(licenses.grams(line) & licenses.grams(t)) / len(licenses.grams(t)) for t in licenses.TEMPLATES[r.family])
                assert abs(r.cover - cover) < 1e-9 and r.confirmed == (cover >= licenses.COVER)


def test_model_is_accurate_on_held_out_rows():
    assert licenses.fit().held_out >= 0.95


def test_odd_rows_and_native_plan(spark):
    df = licenses.scan(spark, frame(spark, ODD + [(50, None, None, None, None)] + 2 * [(60, "Released under the MIT License.", "en", "s", 1)]))
    out = df.collect()
    assert len(out) == len(ODD) + 3 and sorted(r.license for r in out if r.doc_id == 60) == ["MIT", "MIT"]
    assert all(r.license == "unknown" and r.families is None for r in out if r.doc_id != 60)
    assert {r.n_paragraphs for r in out if r.doc_id in (50, 100, 101)} == {0}
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert len(licenses.scan(spark, clashing(frame(spark, rows()))).collect()) == len(rows())
    assert licenses.scan(spark, frame(spark, [])).collect() == []


def test_wrapped_notices(spark):
    """Notices wrapped at 20 to 80 columns, with and without comment marks, are those of one line."""
    import textwrap

    notices = [(f, t) for f, t in PLANTED.values() if f != "unknown"] + [
        ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        ("AGPL", "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License"),
        ("LGPL", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"),
    ]
    rows, want = [], {}
    for width in (20, 47, 60, 70, 80):
        for mark in ("", "# "):
            for f, t in notices:
                want[len(rows)] = f
                body = "\n".join(mark + x for x in textwrap.wrap(t, width, break_on_hyphens=False, break_long_words=False))
                rows.append((len(rows), f"{words(30, len(rows))}\n{body}\n{words(20, len(rows) + 500)}", "en", "s", 1))
    got = {r.doc_id: (r.families, r.license) for r in licenses.scan(spark, frame(spark, rows)).collect()}
    assert {i: (got[i], rows[i][1]) for i in got if got[i] != (want[i], want[i])} == {}


def test_adjacent_notices_and_blank_lines(spark):
    two = "Released under the MIT License.\nThis work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License."
    apart = "This work is licensed under a Creative Commons\n\nAttribution-NonCommercial 4.0 International License."
    got = {r.doc_id: r.families for r in licenses.scan(spark, frame(spark, [(0, two, "en", "s", 1), (1, apart, "en", "s", 1)])).collect()}
    assert got[0] == "CC-BY-NC,MIT" and got[1] != "CC-BY-NC"


#: Notices as projects write them, none of them a template or made from one.
HELD_OUT = [
    ("EPL", 'Eclipse Public License - v 2.0'),
    ("EPL", 'made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution'),
    ("ISC", 'ISC License Copyright (c) 2004 by someone'),
    ("BSL", 'Boost Software License'),
    ("BSL", 'Use, modification and distribution is subject to the Boost Software License, Version 1.0 (see accompanying file)'),
    ("MIT", 'MIT License'),
    ("MIT", 'This code is MIT licensed, see the LICENSE file'),
    ("MIT", 'Code released under the MIT License by the project authors'),
    ("Apache-2.0", 'Apache License Version 2.0, January 2004'),
    ("Apache-2.0", 'See the Apache License, Version 2.0 for details'),
    ("GPL", 'GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007'),
    ("GPL", 'This file is part of a program that is free software under the GNU General Public License, either version 2 or any later version'),
    ("GPL", 'License: GPL-2.0-or-later'),
    ("LGPL", 'GNU LESSER GENERAL PUBLIC LICENSE Version 3'),
    ("LGPL", 'distributed under the LGPL version 3'),
    ("AGPL", 'GNU AFFERO GENERAL PUBLIC LICENSE Version 3'),
    ("AGPL", 'This server is licensed under the AGPLv3'),
    ("MPL", 'The contents of this file are subject to the Mozilla Public License Version 1.1'),
    ("BSD", 'BSD 3-Clause License'),
    ("BSD", 'New BSD License'),
    ("BSD", 'Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation'),
    ("CC-BY", 'Content is licensed under CC BY 3.0'),
    ("CC-BY-SA", 'Creative Commons Attribution-ShareAlike 3.0 Unported License'),
    ("CC-BY-NC", 'licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 License'),
    ("CC-BY-ND", 'Creative Commons Attribution-NoDerivatives 4.0 License'),
    ("CC0", 'CC0 1.0 Universal (CC0 1.0) Public Domain Dedication'),
    ("Unlicense", 'This project uses the Unlicense'),
    ("Zlib", 'zlib License'),
    ("Artistic", 'released under the Artistic License 2.0, like Perl'),
    ("EUPL", 'Licensed under the EUPL v1.2'),
    ("OFL", 'fonts are licensed under the SIL Open Font License 1.1'),
    ("CDDL", 'Common Development and Distribution License 1.0'),
    ("PostgreSQL", 'under the PostgreSQL License, a liberal license'),
    ("PSF", 'Python Software Foundation License Version 2'),
    ("MS-PL", 'This project uses the Microsoft Public License'),
    ("SSPL", 'Server Side Public License v1'),
    ("Proprietary", '(c) 2021 Initech. All Rights Reserved.'),
    ("Public-Domain", 'The author has placed this code in the public domain.'),
    ("WTFPL", 'the WTFPL applies'),
    ("LPPL", 'The LaTeX Project Public License applies'),
    ("OSL", 'Open Software License 3.0'),
    ("AFL", 'Academic Free License 3.0'),
    ("NCSA", 'NCSA Open Source License'),
    ("unknown", 'The IBM Public License Version 1.0'),
    ("unknown", 'Licensed under the Artful Public License, v. 3.0'),
    ("unknown", 'See LICENSE for the license'),
    ("unknown", 'This license does not grant you any right'),
    ("unknown", 'The committee asked MIT for permission'),
    ("unknown", 'The accident in the public commons'),
    ("unknown", 'Nethack General Public License'),
    ("unknown", 'Licensed under the Motosoto Open Source License'),
    ("unknown", 'She has a license to drive a truck'),
    ("unknown", 'reserved seats and public warranty'),
]


def test_held_out_notices(spark):
    """Recall of known families, and what is taken for a family that it isn't."""
    got = {r.doc_id: r.license for r in licenses.scan(spark, frame(spark, [(i, f"{words(20, i)}\n\n{t}\n\n{words(20, i + 99)}", "en", "s", 1) for i, (_, t) in enumerate(HELD_OUT)])).collect()}
    known = [i for i, (f, _) in enumerate(HELD_OUT) if f != "unknown"]
    right = sum(got[i] == HELD_OUT[i][0] for i in known)
    wrong = sum(got[i] not in ("unknown", HELD_OUT[i][0]) for i in got)
    assert right / len(known) >= 0.8 and wrong <= 2
    assert len(licenses.TEMPLATES) >= 25 and got[0] == "EPL"


def test_stems_begin_words():
    assert not any(map(licenses.is_anchor, ("accident", "committee", "accept", "permit", "publication", "summit", "eclair")))
    assert all(map(licenses.is_anchor, ("cc-by-4.0", "gpl-2.0-or-later", "licence", "unlicense", "mit", "by-nc")))

from gaugegrid.llm import licences as L
from tests.llm.conftest import EDGE, documents

APACHE = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except\nin compliance with the License. More text.'
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by\n" \
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
CASES = [
    (101, "Text.\nReleased under the MIT License.\nmore", ["MIT"]), (102, APACHE, ["Apache-2.0"]), (103, GPL, ["GPL-3.0-or-later"]),
    (104, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0.", ["Apache-2.0", "CC-BY-NC-4.0"]),
    (105, "you may not use this file except in compliance with the License.\nLicensed under the Apache License, Version 2.0 (the License)", []),
    (106, "We licensed under the table the MIT license plates.", []),
    (107, f"{GPL}\nThis work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-or-later"]),
    (108, "; ".join(s for n, s in L.SENTENCES.items() if 14 <= n <= 17), ["BSD-3-Clause"]), (109, "; ".join(L.SENTENCES[n] for n in (14, 9, 15, 16)), ["BSD-2-Clause"]),
    (110, "RELEASED UNDER THE MIT LICENSE!", ["MIT"]),
]


def test_cases(spark):
    got = {r.doc_id: r for r in L.scan(documents(spark, [(i, t) for i, t, _ in CASES])).collect()}
    for i, _, want in CASES:
        assert got[i].licences == want and got[i].licence == (want[0] if want else None), (i, got[i])


def test_edges(edge, none):
    got = L.scan(edge).collect()
    assert len(got) == len(EDGE) and all(r.licences == [] and r.sentence_ids == [] for r in got) and L.scan(none).count() == 0


def test_sentences_are_their_own_normal_form(spark):
    rows = [(n, s) for n, s in L.SENTENCES.items()]
    got = L.scan(documents(spark, rows)).collect()
    assert {r.doc_id: r.sentence_ids for r in got} == {n: [n] for n in L.SENTENCES}


NOTICES = {
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
    "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or\nmodify it under the terms of the GNU General Public License\n"
    "as published by the Free Software Foundation; either version 2\nof the License, or (at your option) any later version.\n",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\n"
    "file, You can obtain one at https://mozilla.org/MPL/2.0/.\n",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\n"
    "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
    "    1. Redistributions of source code must retain the above copyright notice,\n       this list of conditions and the following disclaimer.\n\n"
    "    2. Redistributions in binary form must reproduce the above copyright\n       notice, this list of conditions and the following disclaimer in the\n"
    "       documentation and/or other materials provided with the distribution.\n\n    3. Neither the name of the copyright holder nor the names of its\n"
    "       contributors may be used to endorse or promote products derived from\n       this software without specific prior written permission.\n",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\n"
    "in the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n"
    "copies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n"
    "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n",
}
WRAPS = {"plain": ("", "", ""), "star": ("/*\n", " * ", " */\n"), "hash": ("", "# ", ""), "slashes": ("", "// ", ""), "indent": ("", "    ", "")}


def test_published_notices_wrapped_and_commented(spark):
    rows, want = [], {}
    for name, notice in NOTICES.items():
        for first, mark, last in WRAPS.values():
            want[len(rows)] = name
            rows.append((len(rows), "code\n" + first + "".join(f"{mark}{line}".rstrip() + "\n" for line in notice.splitlines()) + last + "import x\n"))
    got = {r.doc_id: r.licences for r in L.scan(documents(spark, rows)).collect()}
    assert got == {i: [name] for i, name in want.items()}

import duckdb

from filmroll.llm import licenses

SCHEMA = "doc_id long, text string, licenses string, sequence int"
MIT = """/* Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
 * documentation files (the "Software"), to deal in the Software without restriction, including without limitation
 * the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
 * permit persons to whom the Software is furnished to do so, subject to the following conditions:
 *
 * The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
 *
 * THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
 * WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. */"""


def scan(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    return {(r.doc_id, i): (r.sentences, r.licenses, r.unmatched, r.unknown) for i, r in enumerate(licenses.scan(df).collect())}


def one(spark, text):
    return next(iter(scan(spark, [(1, text)]).values()))


def test_sentences_and_rules(spark):
    assert one(spark, MIT) == ("MitGrant,MitNotice,MitWarranty", "MIT", "", 0)
    assert one(spark, "Word word\nLicensed under the Apache License, Version 2.0.\nMore. Released under the MIT License.") == ("Apache2Ref,MitRef", "Apache-2.0,MIT", "", 0)
    assert one(spark, "// SPDX-License-Identifier: Apache-2.0\ncode") == ("SpdxApache2", "Apache-2.0", "", 0)


def test_order_counts_and_unknown_sentences_part(spark):
    a, b = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Our own license applies."
    grant = MIT.split(" *\n")[0]
    assert one(spark, f"{a}\n{grant}")[1:] == ("", "MitNotice,MitGrant", 0)
    assert one(spark, f"{grant}\n{b} {a}") == ("MitGrant,UNKNOWN,MitNotice", "", "MitGrant,MitNotice", 1)


def test_every_sentence_has_a_word_and_a_rule():
    import re
    assert all(re.search(licenses.WORDS, s) for s in licenses.SENTENCES)
    used = {s for rule, _ in licenses.RULES for s in rule}
    assert used <= {*licenses.SENTENCES.values()}


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    got = scan(spark, [(None, "Licensed under CC BY-NC 4.0."), (2, None), (3, ""), (4, "x"), (4, "x"), (5, "no words. " * 50_000 + "Licensed under CC BY-NC 4.0.")])
    assert sorted(v[1] for v in got.values()) == ["", "", "", "", "CC-BY-NC-4.0", "CC-BY-NC-4.0"]
    assert scan(spark, []) == {}


GPL = """    This program is free software%s you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation%s either version %s of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License"""
GPL2 = GPL % (";", ";", 2) + """ along
    with this program; if not, write to the Free Software Foundation, Inc.,
    51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
"""
GPL3 = GPL % (":", ",", 3) + """
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
BSD3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""


def test_verbatim_notices(spark):
    commented = lambda t, mark: "".join(f"{mark}{line}".rstrip() + "\n" for line in t.splitlines())
    notices = {"GPL2": GPL2, "GPL3": GPL3, "APACHE": APACHE, "BSD3": BSD3}
    want = {"GPL2": ("Gpl2Later,GplWarranty,GplDetails,GplCopy", "GPL-2.0-or-later", "", 0),
            "GPL3": ("Gpl3Later,GplWarranty,GplDetails,GplCopy,UNKNOWN", "GPL-3.0-or-later", "", 1),  # where to read the licenses
            "APACHE": ("Apache2Head,ApacheUse,ApacheCopy,ApacheWarranty,ApacheLimits", "Apache-2.0", "", 0),
            "BSD3": ("BsdGrant,BsdSource,BsdBinary,BsdEndorse", "BSD-3-Clause", "", 0)}
    forms = [(k, form) for k, t in notices.items() for form in (t, f"Some code.\n{t}\nMore code.", commented(t, " * "), commented(t, "# "), commented(t, "// "))]
    got = scan(spark, [(i, form) for i, (_, form) in enumerate(forms)])
    assert {(k, i): got[i, i] for i, (k, _) in enumerate(forms)} == {(k, i): want[k] for i, (k, _) in enumerate(forms)}


def test_other_semicolons_still_cut(spark):
    assert one(spark, "Released under the MIT License; without any warranty; licensed under the BSD license.")[:2] == ("MitRef,UNKNOWN,BsdRef", "MIT,BSD")


LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
SHORT = {LGPL: "LGPL-2.1-or-later", MPL: "MPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later\ncode": "GPL-2.0-or-later",
         "# SPDX-License-Identifier: MIT OR Apache-2.0": "MIT,Apache-2.0",
         "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause OR LGPL-2.1-only\ncode": "MIT,Apache-2.0,BSD-3-Clause,LGPL-2.1-only",
         "license: MIT OR Apache-2.0": "MIT,Apache-2.0", "Licensed under the MIT license (see LICENSE)": "MIT", "Distributed under the BSD license": "BSD",
         "This is free and unencumbered software released into the public domain.": "Unlicense"}


def crlf(text):
    return text.replace("\n", "\r\n")


def test_more_licences_and_expressions(spark):
    rows = [*SHORT, *map(crlf, SHORT)]
    got = scan(spark, list(enumerate(rows)))
    assert [got[i, i][1] for i in range(len(rows))] == [*SHORT.values()] * 2


def test_line_ends_and_sql_agree(spark):
    rows = [t for n in (MIT, GPL2, GPL3, APACHE, BSD3, *SHORT) for t in (n, crlf(n), f"Prose.\n{n}\nLicense unknown.")]
    got = scan(spark, list(enumerate(rows)))
    assert all(got[i, i][:3] == got[i + 1, i + 1][:3] and got[i, i][1] for i in range(0, len(rows), 3))
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(rows)))
    want = {(r[0], r[0]): tuple(r[1:]) for r in con.execute(f"SELECT doc_id, sentences, licenses, unmatched, unknown FROM ({licenses.ORACLE})").fetchall()}
    assert got == want

"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences, each is normalised and looked up among the known licence sentences; what is left is
the sequence of their identifiers. Rules are tried in order, longest sequences first: each match of a rule's
sequence is taken out of the document's sequence and leaves its licence there, so a sentence counts for one rule.
Sentences that are not known but speak of licensing stay in the sequence as UNKNOWN, and keep a rule from matching
across them; all others drop out.

Known sentences that have a semicolon, or a blank line before a URL, are kept whole (see `WHOLE`). Line ends of CR LF
are LF. A licence expression (`MIT OR Apache-2.0`) is one identifier sentence for each licence it names.

Only documents in which some word of licensing occurs are cut into sentences: every known sentence has one (see
`WORDS`), so nothing is missed.

Result: doc_id, sentences (identifiers in order, comma-joined), licenses (in the order of the text), unmatched
(known sentences that no rule took), unknown (their number). Defined cases: a null or empty text has none of them
(empty strings, zero); repeated rows each get a row; null ids stay null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmroll.llm.common import texts

# Public licence sentences, lower case, without punctuation but + . : - inside words.
SENTENCES = {
    "licensed under cc by 4.0": "CcBy4Ref",
    "licensed under cc by-sa 4.0": "CcBySa4Ref",
    "licensed under cc by-nc 4.0": "CcByNc4Ref",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "licensed under the bsd license": "BsdRef",
    "licensed under the apache license version 2.0": "Apache2Ref",
    "licensed under the apache license version 2.0 the license": "Apache2Head",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at http: www.apache.org licenses license-2.0": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheWarranty",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheLimits",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "this program is free software: you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GplWarranty",
    "see the gnu general public license for more details": "GplDetails",
    "you should have received a copy of the gnu general public license along with this program": "GplCopy",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BsdDisclaimer",
    "this source code form is subject to the terms of the mozilla public license v": "Mpl2Form",
    "this is free and unencumbered software released into the public domain": "UnlicenseGrant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "see the gnu lesser general public license for more details": "LgplDetails",
    "see the gnu affero general public license for more details": "AgplDetails",
    "spdx-license-identifier: mit": "SpdxMit",
    "spdx-license-identifier: apache-2.0": "SpdxApache2",
    "spdx-license-identifier: bsd-2-clause": "SpdxBsd2",
    "spdx-license-identifier: bsd-3-clause": "SpdxBsd3",
    "spdx-license-identifier: gpl-2.0-only": "SpdxGpl2",
    "spdx-license-identifier: gpl-3.0-only": "SpdxGpl3",
    "spdx-license-identifier: gpl-3.0-or-later": "SpdxGpl3Later",
}
# Sequences of sentences and the licence they make, in the order they are tried.
RULES = [
    (["Apache2Head", "ApacheUse", "ApacheCopy", "ApacheWarranty", "ApacheLimits"], "Apache-2.0"),
    (["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdDisclaimer"], "BSD-3-Clause"),
    (["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"], "BSD-3-Clause"),
    (["Gpl3Later", "GplWarranty", "GplDetails", "GplCopy"], "GPL-3.0-or-later"),
    (["Gpl2Later", "GplWarranty", "GplDetails", "GplCopy"], "GPL-2.0-or-later"),
    (["BsdGrant", "BsdSource", "BsdBinary", "BsdDisclaimer"], "BSD-2-Clause"),
    (["BsdGrant", "BsdSource", "BsdBinary"], "BSD-2-Clause"),
    (["MitGrant", "MitNotice", "MitWarranty"], "MIT"),
    (["Gpl3Later", "GplWarranty"], "GPL-3.0-or-later"),
    (["Gpl2Later", "GplWarranty"], "GPL-2.0-or-later"),
    (["MitGrant", "MitNotice"], "MIT"),
    (["Gpl3Later"], "GPL-3.0-or-later"),
    (["Gpl2Later"], "GPL-2.0-or-later"),
    (["IscGrant"], "ISC"),
    (["ZlibGrant"], "Zlib"),
    (["UnlicenseGrant"], "Unlicense"),
    (["Mpl2Form"], "MPL-2.0"),
    (["Apache2Head"], "Apache-2.0"),
    (["Apache2Ref"], "Apache-2.0"),
    (["Gpl3Ref"], "GPL-3.0"),
    (["Gpl2Ref"], "GPL-2.0"),
    (["MitRef"], "MIT"),
    (["BsdRef"], "BSD"),
    (["CcByNc4Ref"], "CC-BY-NC-4.0"),
    (["CcBySa4Ref"], "CC-BY-SA-4.0"),
    (["CcBy4Ref"], "CC-BY-4.0"),
    (["SpdxMit"], "MIT"),
    (["SpdxApache2"], "Apache-2.0"),
    (["SpdxBsd2"], "BSD-2-Clause"),
    (["SpdxBsd3"], "BSD-3-Clause"),
    (["SpdxGpl2"], "GPL-2.0"),
    (["SpdxGpl3"], "GPL-3.0"),
    (["SpdxGpl3Later"], "GPL-3.0-or-later"),
]
# The notices of the GNU family, and public licence identifiers.
FAMILY = [("", "GPL", ("2", "3")), ("lesser ", "LGPL", ("2.1", "3")), ("affero ", "AGPL", ("3",))]
PLAIN_IDS = ["MIT", "ISC", "Zlib", "Unlicense", "0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0"]
GNU_IDS = ["GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"]
LICENCE_IDS = PLAIN_IDS + [f"{i}{end}" for i in GNU_IDS for end in ("", "-only", "-or-later")]
for kind, short, versions in FAMILY:
    for version in versions:
        name, licence = f"{short.capitalize()}{version}Later", f"{short}-{version if '.' in version else version + '.0'}-or-later"
        for subject in ("program", "library", "file"):
            for mark in ("", ":"):
                SENTENCES.setdefault(f"this {subject} is free software{mark} you can redistribute it and or modify it under the terms of the gnu {kind}general public license as published by "
                                     f"the free software foundation either version {version} of the license or at your option any later version", name)
        if kind:
            RULES += [([name, "GplWarranty", f"{short.capitalize()}Details"], licence), ([name, "GplWarranty"], licence), ([name], licence)]
for subject in ("library", "file"):
    SENTENCES[f"this {subject} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"] = "GplWarranty"
for verb in ("licensed", "released", "distributed"):
    for end in ("", " see license", " see license for details", " see the license file", " see the license file for details"):
        for said, name in (("the mit license", "MitRef"), ("the bsd license", "BsdRef"), ("the apache license version 2.0", "Apache2Ref")):
            SENTENCES.setdefault(f"{verb} under {said}{end}", name)
for licence in LICENCE_IDS:
    if f"spdx-license-identifier: {licence.lower()}" not in SENTENCES:
        SENTENCES[f"spdx-license-identifier: {licence.lower()}"] = f"Spdx{licence}"
        RULES.append(([f"Spdx{licence}"], licence))
#: Words of which every known sentence has one.
WORDS = "licen[cs]|copyright|warrant|permi|redistribut|unencumber"
#: A line that starts so starts a sentence, even after a line without a full stop.
STARTS = ("Licensed under|Released under|Distributed under|This work is|This program is|This library is|This Source Code|This software is|This is free|Permission is|Permission to|Redistribution|Neither the|"
          "THE SOFTWARE IS|The software is|The above copyright|You may|Unless required|You should have|See the|SPDX-")
LINE_START = f"[\\x0A\\x0D]+[\\x20\\x09/*#;%-]*({STARTS})"
#: An identifier ends with its line.
IDENTIFIER = "(SPDX-License-Identifier:[^\\x0A\\x0D]*)"
SENTENCE_END = "[.!?]+[\\x20\\x09-\\x0D]+|[.!?]+$|;[\\x20\\x09-\\x0D]+|:[\\x20\\x09]*[\\x0A\\x0D]+|[\\x0A\\x0D][\\x20\\x09]*[\\x0A\\x0D]+"
#: What lies between two words of a notice: white space, line ends, comment marks.
GAP = "[^A-Za-z0-9.!?;:]+"
#: Where SENTENCE_END would cut a known sentence within itself, and what stands between the two sides instead.
WHOLE = [(pattern.replace(" ", GAP), between) for pattern, between in (
    ("(?i)\\b(free software);( you can redistribute\\b)", ","),
    ("(?i)\\b(free software foundation);( either version [0-9])", ","),
    ("(?i)\\b(without any warranty);( without even the implied\\b)", ","),
    ("(?i)\\b(you may obtain a copy of the license at):? (https?://)", " "))]
_IDS = "|".join(sorted((i.replace(".", "[.]") for i in LICENCE_IDS), key=len, reverse=True))
#: Two licences of an expression. Replaced twice, it parts expressions of any length: first each other pair, then those between.
EXPRESSION = f"(?:SPDX-License-Identifier:[\\x20(]*)?\\b({_IDS})[\\x20)]*\\x20(?:OR|AND)\\x20[\\x20(]*(?:\\x0ASPDX-License-Identifier:\\x20)?({_IDS})\\b\\)*"
TAG = "SPDX-License-Identifier: "
NOISE = "[^a-z0-9+.:-]+"
EDGES = "^[ .:+-]+|[ .:+-]+$"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences, licenses, unmatched, unknown of every row of `docs`."""
    known = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])

    def identify(sentence):
        plain = F.regexp_replace(F.regexp_replace(F.lower(sentence), NOISE, " "), EDGES, "")
        return F.coalesce(F.try_element_at(known, plain), F.when(plain.rlike(WORDS), F.lit("UNKNOWN")))

    lines = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    parted = reduce(lambda c, _: F.regexp_replace(c, EXPRESSION, f"\n{TAG}$1\n{TAG}$2"), range(2), lines)
    whole = reduce(lambda c, w: F.regexp_replace(c, F.lit(w[0]), F.lit(f"$1{w[1]}$2")), WHOLE, parted)
    begun = F.regexp_replace(F.regexp_replace(whole, IDENTIFIER, "$1.\n"), LINE_START, ".\n$1")
    found = F.filter(F.transform(F.split(begun, SENTENCE_END), identify), lambda s: s.isNotNull())
    sequence = F.when(F.col("text").rlike(f"(?i){WORDS}"), F.array_join(F.transform(found, lambda s: F.concat(F.lit("<"), s, F.lit(">"))), ""))
    t = texts(docs).select("doc_id", F.coalesce(sequence, F.lit("")).alias("sequence"))
    taken = reduce(lambda c, rule: F.replace(c, F.lit("".join(f"<{s}>" for s in rule[0])), F.lit(f"{{{rule[1]}}}")), RULES, F.col("sequence"))
    t = t.withColumn("taken", taken)
    listed = lambda c, pattern: F.array_join(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), ",")
    return t.select("doc_id", listed(F.col("sequence"), "<([^>]*)>").alias("sentences"), listed(F.col("taken"), "\\{([^}]*)\\}").alias("licenses"),
                    listed(F.regexp_replace("taken", "<UNKNOWN>", ""), "<([^>]*)>").alias("unmatched"),
                    F.regexp_count("taken", F.lit("<UNKNOWN>")).cast("bigint").alias("unknown"))


def _oracle() -> str:
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SENTENCES.items()) + "}"
    taken = reduce(lambda c, rule: f"replace({c}, '{''.join(f'<{s}>' for s in rule[0])}', '{{{rule[1]}}}')", RULES, "sequence")
    parted = reduce(lambda c, _: f"regexp_replace({c}, '{EXPRESSION}', E'\\n{TAG}\\\\1\\n{TAG}\\\\2', 'g')", range(2), "replace(text, chr(13) || chr(10), chr(10))")
    whole = reduce(lambda c, w: f"regexp_replace({c}, '{w[0]}', '\\1{w[1]}\\2', 'g')", WHOLE, parted)
    return f"""
WITH cut AS (SELECT doc_id, unnest(list_zip(parts, range(len(parts)))) AS part FROM (
    SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace({whole}, '{IDENTIFIER}', E'\\\\1.\\n', 'g'), '{LINE_START}', E'.\\n\\\\1', 'g'), '{SENTENCE_END}') AS parts FROM documents)),
plain AS (SELECT doc_id, part[2] AS pos, regexp_replace(regexp_replace(lower(part[1]), '{NOISE}', ' ', 'g'), '{EDGES}', '', 'g') AS s FROM cut),
named AS (SELECT doc_id, pos, coalesce({known}[s], CASE WHEN regexp_matches(s, '{WORDS}') THEN 'UNKNOWN' END) AS id FROM plain),
seq AS (SELECT d.doc_id, coalesce(any_value(n.sequence), '') AS sequence FROM documents d LEFT JOIN (
    SELECT doc_id, string_agg('<' || id || '>', '' ORDER BY pos) AS sequence FROM named WHERE id IS NOT NULL GROUP BY doc_id) n USING (doc_id) GROUP BY d.doc_id),
done AS (SELECT doc_id, sequence, {taken} AS taken FROM seq)
SELECT doc_id, array_to_string(regexp_extract_all(sequence, '<([^>]*)>', 1), ',') AS sentences,
    array_to_string(regexp_extract_all(taken, '\\{{([^}}]*)\\}}', 1), ',') AS licenses,
    array_to_string(regexp_extract_all(replace(taken, '<UNKNOWN>', ''), '<([^>]*)>', 1), ',') AS unmatched,
    len(regexp_extract_all(taken, '<UNKNOWN>'))::BIGINT AS unknown FROM done"""


ORACLE = _oracle()

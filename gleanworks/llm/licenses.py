"""License recognition by sentences and rules, in DataFrame functions alone (operator 4).

A text is cut into pieces (at line feeds, and at ``.``, ``!``, ``?``, ``;`` or ``:`` before a blank), each is normalised
(A-Z lower-cased, everything but a-z and 0-9 a blank). A known licence sentence is a run of whole pieces that
make it up when joined: sentences wrapped over lines, with comment marks or without, are found, and so are
those with a cut inside (``v. 2.0``); a blank line ends a run, and an enumerator (``1``, ``b``, ``iv``) may stand
before it. n_sentences counts the pieces with a letter or digit. The ids found, in their order, are matched against
rules, in the rules' order: a rule is a run of ids; where it matches it consumes them, so a full text or a
notice is told from the short phrases it holds. A mark stays in their place: what stood before and behind them is
no run. Quotes written as character entities are blanks.

It all happens within the row: no shuffle, no join, whatever the sizes of groups; pieces of any length are read.

Defined results: null and empty texts hold no sentences, and no licences (empty string); known sentences
that no rule takes are counted as unmatched; repeated rows, ties and extra columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences by id (public licence texts and their usual notices).
SENTENCES = {
    "mit-ref": [
        "Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License",
        "Distributed under the MIT License", "SPDX-License-Identifier: MIT"
    ],
    "mit-grant": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ],
    "mit-notice": [
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software"
    ],
    "as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"
    ],
    "mit-liability": [
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
    ],
    "isc-ref": ["Licensed under the ISC License", "Released under the ISC License", "SPDX-License-Identifier: ISC"],
    "isc-grant": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
    ],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "isc-as-is": [
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS"
    ],
    "apache-ref": [
        "Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\")", "This project is licensed under the Apache License 2.0",
        "SPDX-License-Identifier: Apache-2.0"
    ],
    "apache-comply": ["you may not use this file except in compliance with the License"],
    "apache-copy": ["You may obtain a copy of the License at"],
    "apache-terms": ["TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"],
    "apache-body": [
        "\"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document"
    ],
    "gpl3-ref": [
        "This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3",
        "Released under the GNU General Public License v3.0", "SPDX-License-Identifier: GPL-3.0-only"
    ],
    "gpl2-ref": [
        "This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2",
        "SPDX-License-Identifier: GPL-2.0-only"
    ],
    "gpl3-later-ref": ["SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl2-later-ref": ["SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl-redistribute": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "gpl2-redistribute": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"
    ],
    "gpl-warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"],
    "gpl3-title": ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "gpl2-title": ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "fsf-copying": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"],
    "lgpl3-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21-title": ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl3-ref": [
        "Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later"
    ],
    "lgpl21-ref": [
        "Licensed under the GNU Lesser General Public License, version 2.1", "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later"
    ],
    "lgpl3-redistribute": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "lgpl21-redistribute": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"
    ],
    "agpl3-title": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "agpl3-ref": [
        "Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later"
    ],
    "agpl3-redistribute": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"
    ],
    "bsd-redistribution": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"
    ],
    "bsd-endorse": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Neither the name of the author nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission"
    ],
    "bsd-advertising": ["All advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "bsd-ref": ["Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "bsd2-ref": ["Licensed under the BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty"],
    "zlib-grant": [
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
    ],
    "zlib-ref": ["Licensed under the zlib License", "SPDX-License-Identifier: Zlib"],
    "boost-ref": [
        "Distributed under the Boost Software License, Version 1.0", "Licensed under the Boost Software License, Version 1.0",
        "SPDX-License-Identifier: BSL-1.0"
    ],
    "unlicense-grant": ["This is free and unencumbered software released into the public domain"],
    "unlicense-rights": [
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"
    ],
    "unlicense-ref": ["Released under the Unlicense", "SPDX-License-Identifier: Unlicense"],
    "epl2-ref": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
        "Licensed under the Eclipse Public License, version 2.0", "SPDX-License-Identifier: EPL-2.0"
    ],
    "epl1-ref": [
        "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at",
        "SPDX-License-Identifier: EPL-1.0"
    ],
    "cc-by-ref": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa-ref": [
        "Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"
    ],
    "cc-by-nc-ref": [
        "Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"
    ],
    "cc0-ref": [
        "Released under CC0 1.0", "CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"
    ],
    "mpl-ref": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"
    ],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "cc-by-nd-ref": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc-by-nc-sa-ref": [
        "Licensed under CC BY-NC-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"
    ],
    "cc-by-nc-nd-ref": [
        "Licensed under CC BY-NC-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"
    ],
    "apache-grant": [
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form"
    ],
    "gpl3-body": ["The GNU General Public License is a free, copyleft license for software and other kinds of works"],
    "agpl3-body": [
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software"
    ],
    "lgpl3-body": [
        "This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below"
    ],
    "wtfpl-title": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE", "SPDX-License-Identifier: WTFPL"],
    "wtfpl-copying": [
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"
    ],
    "artistic2-ref": ["Licensed under the Artistic License 2.0", "SPDX-License-Identifier: Artistic-2.0"],
    "psf-ref": ["Licensed under the Python Software Foundation License", "SPDX-License-Identifier: PSF-2.0"],
    "eupl-ref": ["Licensed under the EUPL, Version 1.2", "Licensed under the EUPL", "SPDX-License-Identifier: EUPL-1.2"],
    "ofl-ref": ["This Font Software is licensed under the SIL Open Font License, Version 1.1", "SPDX-License-Identifier: OFL-1.1"],
    "cddl-ref": [
        "The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")",
        "SPDX-License-Identifier: CDDL-1.0"
    ],
    "ms-pl-ref": ["Licensed under the Microsoft Public License (MS-PL)", "SPDX-License-Identifier: MS-PL"],
    "odbl-ref": ["SPDX-License-Identifier: ODbL-1.0"],
    "rights": ["All rights reserved"],
}
# Ordered rules, a run of sentence ids and the licence it proves; longer runs come first.
RULES = [
    (("mit-grant", "mit-notice", "as-is", "mit-liability"), "MIT"),
    (("mit-grant", "mit-notice", "as-is"), "MIT"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-endorse"), "BSD-4-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse"), "BSD-3-Clause"),
    (("bsd-redistribution", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("apache-ref", "apache-comply", "apache-copy"), "Apache-2.0"),
    (("apache-terms", "apache-body"), "Apache-2.0"),
    (("zlib-as-is", "zlib-grant"), "Zlib"),
    (("unlicense-grant", "unlicense-rights"), "Unlicense"),
    (("isc-grant", "isc-as-is"), "ISC"),
    (("0bsd-grant", "isc-as-is"), "0BSD"),
    (("mpl-ref", "mpl-copy"), "MPL-2.0"),
    (("gpl3-title", "fsf-copying"), "GPL-3.0"),
    (("gpl2-title", "fsf-copying"), "GPL-2.0"),
    (("lgpl3-title", "fsf-copying"), "LGPL-3.0"),
    (("lgpl21-title", "fsf-copying"), "LGPL-2.1"),
    (("agpl3-title", "fsf-copying"), "AGPL-3.0"),
    (("gpl-redistribute", "gpl-warranty"), "GPL-3.0-or-later"),
    (("gpl2-redistribute", "gpl-warranty"), "GPL-2.0-or-later"),
    (("agpl3-redistribute", "gpl-warranty"), "AGPL-3.0-or-later"),
    (("mit-ref",), "MIT"),
    (("mit-grant",), "MIT"),
    (("apache-ref",), "Apache-2.0"),
    (("gpl3-ref",), "GPL-3.0"),
    (("gpl2-ref",), "GPL-2.0"),
    (("gpl3-title",), "GPL-3.0"),
    (("gpl2-title",), "GPL-2.0"),
    (("gpl3-later-ref",), "GPL-3.0-or-later"),
    (("gpl2-later-ref",), "GPL-2.0-or-later"),
    (("gpl-redistribute",), "GPL-3.0-or-later"),
    (("gpl2-redistribute",), "GPL-2.0-or-later"),
    (("lgpl3-ref",), "LGPL-3.0"),
    (("lgpl21-ref",), "LGPL-2.1"),
    (("lgpl3-title",), "LGPL-3.0"),
    (("lgpl21-title",), "LGPL-2.1"),
    (("lgpl3-redistribute",), "LGPL-3.0-or-later"),
    (("lgpl21-redistribute",), "LGPL-2.1-or-later"),
    (("agpl3-ref",), "AGPL-3.0"),
    (("agpl3-title",), "AGPL-3.0"),
    (("agpl3-redistribute",), "AGPL-3.0-or-later"),
    (("isc-ref",), "ISC"),
    (("isc-grant",), "ISC"),
    (("0bsd-grant",), "0BSD"),
    (("bsd-ref",), "BSD-3-Clause"),
    (("bsd2-ref",), "BSD-2-Clause"),
    (("zlib-grant",), "Zlib"),
    (("zlib-ref",), "Zlib"),
    (("boost-ref",), "BSL-1.0"),
    (("unlicense-grant",), "Unlicense"),
    (("unlicense-ref",), "Unlicense"),
    (("epl2-ref",), "EPL-2.0"),
    (("epl1-ref",), "EPL-1.0"),
    (("cc-by-sa-ref",), "CC-BY-SA-4.0"),
    (("cc-by-nc-ref",), "CC-BY-NC-4.0"),
    (("cc-by-ref",), "CC-BY-4.0"),
    (("cc0-ref",), "CC0-1.0"),
    (("mpl-ref",), "MPL-2.0"),
    (("cc-by-nd-ref",), "CC-BY-ND-4.0"),
    (("cc-by-nc-sa-ref",), "CC-BY-NC-SA-4.0"),
    (("cc-by-nc-nd-ref",), "CC-BY-NC-ND-4.0"),
    (("apache-grant",), "Apache-2.0"),
    (("gpl3-body",), "GPL-3.0"),
    (("agpl3-body",), "AGPL-3.0"),
    (("lgpl3-body",), "LGPL-3.0"),
    (("wtfpl-title",), "WTFPL"),
    (("wtfpl-copying",), "WTFPL"),
    (("artistic2-ref",), "Artistic-2.0"),
    (("psf-ref",), "PSF-2.0"),
    (("eupl-ref",), "EUPL-1.2"),
    (("ofl-ref",), "OFL-1.1"),
    (("cddl-ref",), "CDDL-1.0"),
    (("ms-pl-ref",), "MS-PL"),
    (("odbl-ref",), "ODbL-1.0"),
    (("rights",), "all-rights-reserved"),
]
#: What stands in the list of ids in place of a run that a rule has taken, so that its neighbours stay apart.
TAKEN = "/"
CUT = r"\n|[.!?;:][ \t\r]"
# Characters of markup that stand for quotes and the like.
ENTITY = "&(?:quot|apos|amp|lt|gt|nbsp|[lr][sd]quo|#[0-9]{1,5});"
# A line feed and the comment mark after it; what may number a sentence.
COMMENT = r"\n[ \t]*(?:[;#/*%!-]+|(?:dnl|rem|REM)(?=[ \t\r\n]))[ \t]*"
ENUMERATOR = "(?:[0-9]{1,2} |[a-z] |[ivx]{1,4} )?"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(sentence: str) -> str:
    """As normal_form() does it."""
    low = sentence.translate(str.maketrans(UPPER, LOWER))
    return " ".join("".join(c if c in LOWER or c in "0123456789" else " " for c in low).split())


def known() -> dict[str, str]:
    """Normalised sentence (as far as a cut leaves it whole) to id."""
    return {normalised(s): name for name, forms in SENTENCES.items() for s in forms}


def normal_form(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_license_sentences, sentence_ids, licenses, n_unmatched."""
    table = known()
    lookup = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    # a known sentence is a run of whole pieces, the longest first; an empty piece (a blank line) ends a run
    runs = "|".join(k.replace(" ", "[ |]") for k in sorted(table, key=len, reverse=True))
    text = F.regexp_replace(F.coalesce("text", F.lit("")), ENTITY, " ")
    pieces = F.transform(F.split(F.regexp_replace(text, COMMENT, "\n"), CUT), normal_form)
    whole = F.concat(F.lit("|"), F.array_join(pieces, "|"), F.lit("|"))
    ids = F.transform(F.regexp_extract_all(whole, F.lit(rf"(?<=\|){ENUMERATOR}({runs})(?=\|)"), F.lit(1)), lambda s: lookup[F.translate(s, "|", " ")])
    rows = docs.select(
        "doc_id", F.size(F.filter(F.split(text, CUT), lambda s: s.rlike("[A-Za-z0-9]"))).cast("long").alias("n_sentences"), ids.alias("ids")
    )
    rules = F.array(*(F.struct(F.lit(_run(run)).alias("run"), F.lit(name).alias("name")) for run, name in RULES))
    start = F.struct(F.concat(F.lit(","), F.array_join("ids", ",,"), F.lit(",")).alias("rest"), F.array().cast("array<string>").alias("names"))

    def apply(state: Column, rule: Column) -> Column:
        names = F.when(state["rest"].contains(rule["run"]), F.array_append(state["names"], rule["name"])).otherwise(state["names"])
        return F.struct(F.replace(state["rest"], rule["run"], F.lit(TAKEN)).alias("rest"), names.alias("names"))

    # the rules are gone through only where there is anything to match
    done = F.when(F.size("ids") > 0, F.aggregate(rules, start, apply))
    rows = rows.withColumn("done", done)
    licenses = F.coalesce(F.array_join(F.array_distinct("done.names"), ","), F.lit(""))
    left = F.coalesce(F.size(F.filter(F.split("done.rest", ","), lambda s: F.replace(s, F.lit(TAKEN), F.lit("")) != "")), F.lit(0)).cast("long")
    return rows.select(
        "doc_id", "n_sentences", F.size("ids").cast("long").alias("n_license_sentences"), F.array_join("ids", ",").alias("sentence_ids"),
        licenses.alias("licenses"), left.alias("n_unmatched")
    )


def _run(ids: tuple[str, ...]) -> str:
    """A run as it stands in a joined list, where each id has a comma on either side."""
    return ",".join(f",{i}," for i in ids).replace(",,,", ",,")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB SQL for scanned() over documents: pieces between doubled bars, as its patterns don't look around."""
    table = known()
    cases = " ".join(f"when {_quoted(k)} then {_quoted(v)}" for k, v in table.items())
    runs = "|".join(k.replace(" ", r"(?: |\|\|)") for k in sorted(table, key=len, reverse=True))
    form = f"trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'))"
    # a word mark is followed by a blank or line end, which stays (patterns here don't look ahead)
    marks = r"\n[ \t]*(?:[;#/*%!-]+|(?:dnl|rem|REM)([ \t\r\n]))[ \t]*"
    steps, names = "rest0", []
    layers = "select doc_id, n_sentences, ids, ',' || array_to_string(ids, ',,') || ',' as rest0 from found"
    for n, (run, name) in enumerate(RULES):
        wanted = _quoted(_run(run))
        names.append(f"case when has{n} then {_quoted(name)} end")
        layers = f"select *, contains(rest{n}, {wanted}) as has{n}, replace(rest{n}, {wanted}, '{TAKEN}') as rest{n + 1} from ({layers})"
        steps = f"rest{n + 1}"
    return f"""
with texts as (select doc_id, regexp_replace(coalesce(text, ''), '{ENTITY}', ' ', 'g') as text from documents),
cut as (select doc_id, len(list_filter(regexp_split_to_array(text, '{CUT}'), lambda s: regexp_matches(s, '[A-Za-z0-9]'))) as n_sentences,
  '||' || array_to_string(list_transform(regexp_split_to_array(regexp_replace(text, '{marks}', chr(10) || '\\1', 'g'), '{CUT}'), lambda s: {form}), '||') || '||' as whole from texts),
found as (select doc_id, cast(n_sentences as bigint) as n_sentences,
  list_transform(regexp_extract_all(whole, '\\|{ENUMERATOR}({runs})\\|', 1), lambda p: case replace(p, '||', ' ') {cases} end) as ids from cut),
ruled as ({layers}),
named as (select *, list_filter([{", ".join(names)}], lambda x: x is not null) as every from ruled)
select doc_id, n_sentences, cast(len(ids) as bigint) as n_license_sentences, array_to_string(ids, ',') as sentence_ids,
  array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), ',') as licenses,
  cast(len(list_filter(string_split({steps}, ','), lambda s: replace(s, '{TAKEN}', '') <> '')) as bigint) as n_unmatched
from named"""

"""License scans by sentence rules.

A text is cut into sentences, twice: at line ends as well as after sentence marks, and after sentence marks and
blank lines only (for wrapped notices). Sentences are normalised (A-Z lower-cased, everything but a-z and 0-9 is
a space) and looked up among known licence sentences; what isn't known is a gap. A known sentence may itself have
marks followed by white space ("SPDX-License-Identifier: MIT"), so it is cut likewise and is a run of pieces. The
sequence of pieces is matched against ordered rules: a rule is a run of identifiers, each any of its sentences, without
a gap and takes what it matches, so that longer notices go before the references they contain.

Only texts with one of the anchor words, derived from the sentences, can hold a known sentence, so others aren't cut.

Cases: null and empty texts have no licences; sentences are matched in whole, however long; repeated rows get equal
results; empty tables give empty results; extra columns are kept, those the result adds replace those of the same name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreframe.llm.shared import LOWER, UPPER

#: Known licence sentences, by identifier; fixed values.
SENTENCES = {
    "mit-ref": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT", "MIT License", "The MIT License", "The MIT License (MIT)"],
    "mit-grant": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "as-is-mit": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "no-liability-mit": ["IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."],
    "apache-ref": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Apache License 2.0", "This project is licensed under the Apache License 2.0."],
    "apache-grant": ['Licensed under the Apache License, Version 2.0 (the "License");'],
    "apache-comply": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0"],
    "apache-as-is": ['Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "gpl2-ref": ["SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "Licensed under the GNU General Public License v2.0."],
    "gpl3-ref": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-even": ["without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "lgpl-ref": ["SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later", "SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "lgpl2-free": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "lgpl3-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "agpl-ref": ["SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "agpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "bsd-ref": ["SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD 3-Clause License.", "BSD 3-Clause License"],
    "bsd2-ref": ["SPDX-License-Identifier: BSD-2-Clause", "Released under the BSD 2-Clause License.", "BSD 2-Clause License"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "* Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-name": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "as-is-bsd": ['THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'],
    "isc-ref": ["SPDX-License-Identifier: ISC", "ISC License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "0bsd-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "as-is-isc": ['THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'],
    "mpl-ref": ["SPDX-License-Identifier: MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "unlicense-free": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "unlicense-anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "zlib-as-is": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib-grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "boost-ref": ["Distributed under the Boost Software License, Version 1.0.", "SPDX-License-Identifier: BSL-1.0"],
    "epl-ref": ["SPDX-License-Identifier: EPL-2.0"],
    "cc-by-nc-nd-ref": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "cc-by-nc-sa-ref": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "cc-by-nc-ref": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa-ref": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "cc-by-nd-ref": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "cc-by-ref": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc0-ref": ["This work is dedicated to the public domain under the CC0 1.0 Universal licence.", "SPDX-License-Identifier: CC0-1.0"],
    "reserved": ["All rights reserved."],
}
#: Ordered rules: (licence, identifiers in a row).
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is-mit", "no-liability-mit")),
    ("MIT", ("mit-grant", "mit-notice", "as-is-mit")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache-grant", "apache-comply", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-grant", "apache-comply", "apache-copy", "apache-as-is")),
    ("Apache-2.0", ("apache-grant", "apache-comply")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", "as-is-bsd")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "as-is-bsd")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("GPL-2.0", ("gpl2-free", "gpl-hope", "gpl-even")),
    ("GPL-3.0", ("gpl-free", "gpl-hope", "gpl-even")),
    ("AGPL-3.0", ("agpl-free", "gpl-hope", "gpl-even")),
    ("LGPL-3.0", ("lgpl3-free", "gpl-hope", "gpl-even")),
    ("GPL-2.0", ("gpl2-free", "gpl-hope")),
    ("GPL-3.0", ("gpl-free", "gpl-hope")),
    ("AGPL-3.0", ("agpl-free", "gpl-hope")),
    ("LGPL-3.0", ("lgpl3-free", "gpl-hope")),
    ("GPL-2.0", ("gpl2-free",)),
    ("GPL-3.0", ("gpl-free",)),
    ("AGPL-3.0", ("agpl-free",)),
    ("LGPL-3.0", ("lgpl3-free",)),
    ("LGPL-2.1", ("lgpl2-free",)),
    ("ISC", ("isc-grant", "as-is-isc")),
    ("0BSD", ("0bsd-grant", "as-is-isc")),
    ("MPL-2.0", ("mpl-ref", "mpl-copy")),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("MPL-2.0", ("mpl-ref",)),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-grant",)),
    ("MIT", ("mit-grant",)),
    ("Apache-2.0", ("apache-grant",)),
    ("BSD", ("bsd-grant",)),
    ("BSD-3-Clause", ("bsd-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("MIT", ("mit-ref",)),
    ("Apache-2.0", ("apache-ref",)),
    ("GPL-2.0", ("gpl2-ref",)),
    ("GPL-3.0", ("gpl3-ref",)),
    ("LGPL", ("lgpl-ref",)),
    ("AGPL-3.0", ("agpl-ref",)),
    ("ISC", ("isc-ref",)),
    ("BSL-1.0", ("boost-ref",)),
    ("EPL-2.0", ("epl-ref",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd-ref",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("all-rights-reserved", ("reserved",)),
)
#: Words that most licence sentences have.
ANCHORS = ("license", "licence", "permission", "copyright", "warrant", "redistribut", "distribute", "public domain", "rights reserved")


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def known_sentences(sentences: dict[str, list[str]] = SENTENCES) -> dict[str, str]:
    return {normalised(s): name for name, found in sentences.items() for s in found}


def pieces_of(sentence: str) -> list[str]:
    """A sentence cut as texts are, each piece normalised."""
    plain = re.sub(r"[\x20\x09-\x0D]+", " ", sentence)
    return [x for x in map(normalised, re.sub(r"([.!?;:]) ", "\\1\n", plain).split("\n")) if x]


def numbered(sentences: dict[str, list[str]]) -> tuple[dict[str, int], dict[str, list[str]]]:
    """(numbers of all pieces, the runs of pieces of each identifier as text, shortest first)."""
    cut = {name: [run for s in found if (run := pieces_of(s))] for name, found in sentences.items()}
    numbers = {x: i for i, x in enumerate(dict.fromkeys(x for runs in cut.values() for run in runs for x in run))}
    return numbers, {name: ["".join(f"<{numbers[x]}>" for x in run) for run in sorted(runs, key=len)] for name, runs in cut.items()}


def anchors(sentences: dict[str, list[str]]) -> list[str]:
    """Words of which every sentence has one: of ANCHORS, else its longest."""
    plain = [x for found in sentences.values() for s in found if (x := normalised(s))]
    return sorted({next((a for a in ANCHORS if a in s), max(s.split(), key=len)) for s in plain})


def _sequence(text: Column, known: Column) -> Column:
    """Numbers of pieces in order as <number>, with . for what isn't known."""
    cut = F.split(F.regexp_replace(text, r"([.!?;:])[\x20\x09-\x0D]+", "$1\n"), "\n")
    plain = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.translate(s, UPPER, LOWER), "[^a-z0-9]+", " ")))
    plain = F.filter(plain, lambda s: s != "")
    return F.array_join(F.transform(plain, lambda s: F.coalesce(F.concat(F.lit("<"), F.try_element_at(known, s).cast("string"), F.lit(">")), F.lit("."))), "")


def _any(runs: list[str]) -> str:
    return f"(?:{'|'.join(runs)})" if runs else "(?!)"


def _matches(sequence: Column, rules, runs: dict[str, list[str]]) -> Column:
    """Names of the rules' licences that match, in order of the rules; each rule takes what it matches."""
    found, rest = [], sequence
    for licence, run in rules:
        text = "".join(_any(runs.get(x, [])[::-1]) for x in run)
        found.append(F.when(F.rlike(rest, F.lit(text)), F.lit(licence)))
        rest = F.regexp_replace(rest, text, ".")
    return F.array_compact(F.array(*found))


def license_scan(docs: DataFrame, text_col: str = "text", sentences: dict[str, list[str]] = SENTENCES, rules=RULES) -> DataFrame:
    """docs with licenses: the distinct licences found, sorted, and n_sentences: known sentences when cut at line ends."""
    numbers, runs = numbered(sentences)
    known = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    maybe = F.coalesce(F.rlike(F.translate(F.col(text_col), UPPER, LOWER), F.lit("|".join(anchors(sentences)))), F.lit(False))
    text = F.when(maybe, F.col(text_col)).otherwise(F.lit(""))
    joined = F.regexp_replace(F.regexp_replace(text, r"\n[\x20\x09]*\n", ". "), r"\n", " ")
    rows = docs.withColumns({"_lines": _sequence(text, known), "_wrapped": _sequence(F.translate(joined, " ", "\n"), known)})
    licences = F.array_sort(F.array_distinct(F.concat(_matches(F.col("_lines"), rules, runs), _matches(F.col("_wrapped"), rules, runs))))
    # shorter sentences first: one whose pieces are sentences themselves counts as these
    every = _any(sorted({x for each in runs.values() for x in each}, key=lambda x: (x.count("<"), x)))
    return rows.withColumns({"licenses": licences, "n_sentences": F.regexp_count("_lines", F.lit(every)).cast("long")}).drop("_lines", "_wrapped")


def oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(s)}, {quoted(name)})" for s, name in known_sentences().items())

    def sequence(text: str) -> str:
        cut = f"string_split(regexp_replace({text}, '([.!?;:])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10))"
        plain = f"list_filter(list_transform({cut}, lambda s: trim(regexp_replace(translate(s, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' ')), lambda s: s <> '')"
        return f"array_to_string(list_transform({plain}, lambda s: coalesce('<' || known[s] || '>', '.')), '')"

    def matches(column: str) -> str:
        rest, found = column, []
        for licence, run in RULES:
            text = "".join(f"<{x}>" for x in run)
            found.append(f"case when contains({rest}, '{text}') then '{licence}' end")
            rest = f"replace({rest}, '{text}', '.')"
        return f"[{', '.join(found)}]"

    wrapped = "translate(regexp_replace(text, '\\n[\\x20\\x09]*\\n', '.' || chr(8233), 'g'), chr(10) || chr(8233), ' ' || chr(10))"
    return f"""
with k as (select map_from_entries(list((s, n))) as known from (values {table}) as v(s, n)),
d as (select doc_id, case when regexp_matches(translate(text, '{UPPER}', '{LOWER}'), '{"|".join(anchors(SENTENCES))}') then text else '' end as text from documents),
q as (select doc_id, {sequence("text")} as lines, {sequence(wrapped)} as wrapped from d, k)
select doc_id, array_to_string(list_sort(list_distinct(list_filter(list_concat({matches("lines")}, {matches("wrapped")}), lambda x: x is not null))), ',') as licenses,
    (length(lines) - length(replace(lines, '<', '')))::bigint as n_sentences from q
"""

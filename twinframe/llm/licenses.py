"""Licence scans by sentence rules.

A text is normalised (lower case, everything but a-z and 0-9 becomes one blank) and sentences that a licence is known
by are replaced with their identifiers. Punctuation and blank lines end a sentence. A line's end may be one too, as in
notices without punctuation, or stand for a blank, as in wrapped ones: a known sentence is found where it begins and
ends at a sentence's or a line's end, over as many lines as it takes; of several that begin there the longest counts.
A rule is a licence and an ordered sequence of identifiers; it matches where its sequence occurs with no other known
sentence between. Rules stand in order: the first that matches names the text. All of it is built-in expressions over
one row; no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import without

# Sentences of public licences and notices, as they read, by identifier.
SENTENCES = {
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "apache2": "Licensed under the Apache License, Version 2.0.",
    "apache2-you": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache2-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "mit": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
    "mit-asis": 'The Software is provided "as is", without warranty of any kind, express or implied.',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-asis": 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties are disclaimed.',
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "reserved": "All rights reserved.",
    "gpl2-redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-redistribute": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd3-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "boost": "Distributed under the Boost Software License, Version 1.0.",
    "mpl11": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License.',
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc-by-nc-sa-4": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-nd-4": "Licensed under CC BY-ND 4.0.",
}

# Rules in order, the more specific first.
RULES = [
    ("GPL-3.0", ["gpl-redistribute", "gpl-hope", "gpl-copy"]),
    ("Apache-2.0", ["apache2-you", "apache2-obtain", "apache2-asis"]),
    ("MIT", ["mit-permission", "mit-asis"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd3-names", "bsd-asis"]),
    ("BSD", ["bsd-redistribution", "bsd-asis"]),
    ("GPL-3.0", ["gpl3-work"]),
    ("GPL-3.0", ["gpl-redistribute"]),
    ("Apache-2.0", ["apache2"]),
    ("Apache-2.0", ["apache2-you"]),
    ("MIT", ["mit"]),
    ("MIT", ["mit-licensed"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC0-1.0", ["cc0"]),
    ("MPL-2.0", ["mpl2"]),
    ("AGPL-3.0", ["agpl3-redistribute"]),
    ("LGPL-3.0", ["lgpl3-redistribute"]),
    ("LGPL-2.1", ["lgpl21-redistribute"]),
    ("GPL-2.0", ["gpl2-redistribute"]),
    ("ISC", ["isc-permission"]),
    ("Unlicense", ["unlicense"]),
    ("Zlib", ["zlib-asis"]),
    ("BSL-1.0", ["boost"]),
    ("MPL-1.1", ["mpl11"]),
    ("EPL-2.0", ["epl2"]),
    ("CC-BY-NC-SA-4.0", ["cc-by-nc-sa-4"]),
    ("CC-BY-NC-ND-4.0", ["cc-by-nc-nd-4"]),
    ("CC-BY-ND-4.0", ["cc-by-nd-4"]),
]

# Line ends stand for blanks, so a name before a line's end may be part of a longer sentence: that names the licence too.
SCAN_SENTENCES = SENTENCES | {"apache2-named": 'Licensed under the Apache License, Version 2.0 (the "License").'}
_AT = RULES.index(("Apache-2.0", ["apache2-you"])) + 1
SCAN_RULES = [*RULES[:_AT], ("Apache-2.0", ["apache2-named"]), *RULES[_AT:]]

# Sentences as the licences themselves have them, where SENTENCES has short forms. They count as those.
WORDINGS = {
    "apache2-obtain": ["You may obtain a copy of the License at: http://www.apache.org/licenses/LICENSE-2.0"],
    "mit-permission": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "mit-asis": ['THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'],
    "bsd-asis": [
        f'THIS SOFTWARE IS PROVIDED BY THE {who} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
        for who in ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "REGENTS AND CONTRIBUTORS", "AUTHOR AND CONTRIBUTORS")
    ],
}

END = r"[.!?;:]+([ \t\r\n]+|$)|\n+"  # of listed sentences, and of the oracle's, whose texts have no wrapped ones
HARD = r"[.!?;:]+([ \t\r\n]+|$)|\n[^a-z0-9\n]*\n"  # ends that no sentence goes over
BLANK, APART = r"(?: \n? ?|\n ?)", r" ?\n[ \n]*"  # between words; between the parts of a sentence that has several


def normal(sentence: str) -> str:
    """The normal form of one sentence, as the expressions below give it."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in sentence)
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in low).split())


def parts(sentence: str) -> list[str]:
    """A listed sentence that itself holds sentence ends (as 'you; you may') counts as its parts."""
    import re

    return [p for x in re.split(END.replace("([", "(?:["), sentence) if (p := normal(x))]


def _numbered(sentences: dict[str, str]) -> tuple[dict[str, int], dict[str, list[int]]]:
    numbers: dict[str, int] = {}
    return numbers, {k: [numbers.setdefault(p, len(numbers) + 1) for p in parts(v)] for k, v in sentences.items()}


def _wordings(sentences: dict[str, str], wordings: dict[str, list[str]]) -> tuple[dict[str, int], dict[str, list[int]], str]:
    """Numbers of normal forms, numbers by identifier, and a pattern of all forms after a line's end, longest first."""
    numbers, by_name = _numbered(sentences)
    forms = {k: [k] for k in numbers}
    for name in wordings.keys() & sentences.keys():
        if len(by_name[name]) != 1:
            raise ValueError(f"{name} has several parts: it can't have other wordings")
        for w in wordings[name]:
            numbers[" ".join(parts(w))] = by_name[name][0]
            forms[" ".join(parts(w))] = parts(w)
    longest = sorted(forms.values(), key=lambda x: -len(" ".join(x)))
    return numbers, by_name, r"\n ?(" + "|".join(APART.join(p.replace(" ", BLANK) for p in x) for x in longest) + r")(?= ?\n)"


def _found(column: Column, pattern: str) -> Column:
    """Known sentences, normalised. Letters outside A-Z are not folded: they become blanks either way."""
    low = F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    flat = F.concat(F.lit("\n"), F.regexp_replace(F.regexp_replace(low, HARD, "\n\n"), r"[^a-z0-9\n]+", " "), F.lit("\n"))
    return F.transform(F.regexp_extract_all(flat, F.lit(pattern), F.lit(1)), lambda s: F.regexp_replace(s, r"[ \n]+", " "))


def _unused(df: DataFrame, name: str) -> str:
    while name in {c.lower() for c in df.columns}:
        name += "_"
    return name


def scan(df: DataFrame, text: str = "text", sentences: dict[str, str] = SCAN_SENTENCES, rules: list = SCAN_RULES, wordings: dict[str, list[str]] = WORDINGS) -> DataFrame:
    """Adds license_sentences (count of known sentences), license (of the first rule in order that matches, or null)
    and licenses (all licences matched, each once, in the rules' order, joined by commas; '' if none).

    A null or empty text has none. Very long texts take time and memory in proportion to their length. Columns of
    these names in `df` are replaced.
    """
    numbers, by_name, pattern = _wordings(sentences, wordings)
    known = F.create_map(*[F.lit(x) for pair in numbers.items() for x in pair])
    s, ids = (_unused(df, x) for x in ("__sentences", "__ids"))
    base = df.withColumn(s, _found(F.coalesce(df[text], F.lit("")), pattern))
    base = base.withColumn(ids, F.concat(F.lit(" "), F.array_join(F.transform(s, lambda x: F.element_at(known, x).cast("string")), "  "), F.lit(" ")))
    hits = [(name, F.col(ids).contains("  ".join(f"{n}" for k in seq for n in by_name[k]).join("  "))) for name, seq in rules]
    found = F.array_distinct(F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in hits]), lambda x: x.isNotNull()))
    has = F.size(s) > 0
    keep = without(df, "license_sentences", "license", "licenses")
    return base.select(
        *[base[c] for c in keep],
        F.size(s).cast("bigint").alias("license_sentences"),
        F.when(has, F.coalesce(*[F.when(hit, F.lit(name)) for name, hit in hits])).alias("license"),
        F.when(has, F.array_join(found, ",")).otherwise("").alias("licenses"),
    )


def oracle(sentences: dict[str, str] = SENTENCES, rules: list = RULES) -> str:
    numbers, by_name = _numbered(sentences)
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in numbers.items()) + "}"
    like = [(name, f"contains(ids, '{'  '.join(str(n) for k in seq for n in by_name[k]).join('  ')}')") for name, seq in rules]
    first = "CASE " + " ".join(f"WHEN {hit} THEN '{name}'" for name, hit in like) + " END"
    order = list(dict.fromkeys(name for name, _ in like))
    all_of = "concat_ws(',', " + ", ".join(f"CASE WHEN {' OR '.join(hit for n, hit in like if n == name)} THEN '{name}' END" for name in order) + ")"
    return f"""
    WITH lines AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{END}', chr(10), 'g'), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)),
            lambda s: ({known})[trim(s)]), lambda x: x IS NOT NULL) AS found FROM documents),
    coded AS (SELECT doc_id, len(found) AS n, ' ' || coalesce(array_to_string(found, '  '), '') || ' ' AS ids FROM lines)
    SELECT doc_id, n::BIGINT AS license_sentences, {first} AS license, coalesce({all_of}, '') AS licenses FROM coded"""

"""Licences by their sentences.

A text is cut into sentences at a full stop, question or exclamation mark before
white space, at a colon before a line's end, and at blank lines; line ends inside a
sentence are blanks. Sentences are normalised: lower case, comment signs, quotes and
punctuation dropped, white space collapsed, years and holders of a copyright line
taken out. A table maps normalised sentences to sentence identifiers; a sentence that
the table does not know is tried line by line, so a known line behind a line without
a full stop is found. The text's identifiers in their order are then matched with
the rules: a rule is a sequence of identifiers that must follow each other, the
longest rules come first, and identifiers that a rule has used are gone.

All of it is one projection: no shuffle, no state but the fixed tables. Null and
empty texts have no licence; repeated rows are answered each; an empty table gives
no row; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind

# Sentences of public licences, by identifier.
SENTENCES = {
    "mit-ref": ("Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "SPDX-License-Identifier: MIT", "License: MIT"),
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    "mit-notice": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",),
    "as-is": (
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ),
    "no-liability": (
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "isc-ref": ("SPDX-License-Identifier: ISC", "Licensed under the ISC License"),
    "apache-ref": ("Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License, Version 2.0"),
    "apache-header": ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",),
    "apache-copy": ("You may obtain a copy of the License at",),
    "gpl3-ref": ("This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-only"),
    "gpl2-ref": ("This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-2.0-only"),
    "gpl2-plus-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    ),
    "gpl3-plus-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    "gpl-hope": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    ),
    "lgpl-ref": ("Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-only"),
    "mpl-header": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    "bsd3-ref": ("SPDX-License-Identifier: BSD-3-Clause", "Released under the BSD 3-Clause License"),
    "bsd2-ref": ("SPDX-License-Identifier: BSD-2-Clause", "Released under the BSD 2-Clause License"),
    "cc-by-nc-ref": ("Licensed under CC BY-NC 4.0", "This work is licensed under CC BY-NC 4.0"),
    "cc-by-ref": ("Licensed under CC BY 4.0", "This work is licensed under CC BY 4.0"),
    "cc-by-sa-ref": ("Licensed under CC BY-SA 4.0", "This work is licensed under CC BY-SA 4.0"),
    "cc0-ref": ("SPDX-License-Identifier: CC0-1.0", "Released under CC0 1.0"),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "copyright": ("Copyright",),
    "all-rights": ("All rights reserved",),
}
# Licences by their sentences in order.
RULES = (
    ("MIT", ("mit-grant", "mit-notice", "as-is", "no-liability")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-ref",)),
    ("Apache-2.0", ("apache-header", "apache-copy")),
    ("Apache-2.0", ("apache-header",)),
    ("Apache-2.0", ("apache-ref",)),
    ("GPL-3.0-or-later", ("gpl3-plus-header", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl3-plus-header",)),
    ("GPL-2.0-or-later", ("gpl2-plus-header", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-plus-header",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("LGPL-3.0-only", ("lgpl-ref",)),
    ("MPL-2.0", ("mpl-header",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("Unlicense", ("unlicense",)),
)
WORTH = r"(?i)licen[sc]e|spdx|copyright|permission|redistribut|free software|unencumbered|cc0|warrant|all rights|in no event"
_ENDS = r"(?<=[.!?])(?<!\bv\.)\s+|(?<=:)[ \t]*\n\s*|\n\s*\n"
_COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/|\*|//+|#+|;+|--|<!--|-->)[ \t]?"
_COPYRIGHT = r"\Acopyright (?:c )?[0-9]{4}.*\z"


def normal(sentence: Column) -> Column:
    text = F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}\s.\-+/]", " ")
    text = F.regexp_replace(text, r"\.(?=\s|\z)", " ")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.regexp_replace(text, _COPYRIGHT, "copyright")


def normal_text(sentence: str) -> str:
    """``normal`` of a sentence of the tables."""
    text = re.sub(r"[^a-z0-9\s.\-+/]", " ", sentence.lower())
    return " ".join(re.sub(r"\.(?=\s|\Z)", " ", text).split())


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = {normal_text(s): name for name, sentences in SENTENCES.items() for s in sentences}
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])

    def look(sentence: Column) -> Column:
        return bind(normal(sentence), lambda s: F.element_at(table, s))

    def ids(sentence: Column) -> Column:
        lines = F.filter(F.transform(F.split(sentence, "\n"), look), lambda i: i.isNotNull())
        return bind(look(sentence), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(lines))

    return F.flatten(F.transform(F.split(F.regexp_replace(text, _COMMENT, ""), _ENDS), ids))


def licences_of(ids: Column) -> Column:
    """Licences whose rules match a sequence of identifiers."""
    none = F.array().cast("array<string>")
    spelled = F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" "))
    order = sorted(RULES, key=lambda rule: -len(rule[1]))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f" {i} " for i in own)).alias("own")) for name, own in order])
    matched = F.aggregate(
        rules,
        F.struct(spelled.alias("left"), none.alias("found")),
        lambda so_far, rule: F.struct(
            F.replace(so_far["left"], rule["own"], F.lit(" | ")).alias("left"),
            F.when(F.contains(so_far["left"], rule["own"]), F.array_append(so_far["found"], rule["name"])).otherwise(so_far["found"]).alias("found"),
        ),
    )
    return F.when(F.size(ids) > 0, F.array_distinct(matched["found"])).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentence identifiers, and licences in the rules' order, of every row."""
    text, none = F.col(text_col), F.array().cast("array<string>")
    ids = F.when(text.rlike(WORTH), sentence_ids(text)).otherwise(none)
    both = bind(ids, lambda i: F.struct(i.alias("sentences"), licences_of(i).alias("licences")))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), both.alias("both")).select("doc_id", "both.sentences", "both.licences")

"""Licence scans by sentence rules, in DataFrame expressions alone.

A text is cut into sentences twice, at line ends too and across wrapped lines, and normalised to lower-case words. A
sentence's key is what is left of it once holders, years and other wording that differs from notice to notice are out
(SMOOTH, SLOTS). Known keys become identifiers, and ordered rules (longest first) look for their identifier sequences among a
text's identifiers in order; a rule uses up what it matches. Colons and semicolons never cut, since notices use them
inside sentences; a full stop cuts before white space unless it ends "v." or a list's number. SPDX tags and names in
"licensed under the ..." are read by patterns of their own and named as they stand.

Only texts with a cue word are cut: every known sentence holds one. The whole is one projection: no shuffle, no join.

Null and empty texts have no identifiers and no licences. Repeated rows repeat their results; other columns are dropped.
Names beyond NAMES are not recognised, and a notice with changed wording is known by the sentences that it kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of published licence notices in their normalised form, by identifier.
SENTENCES = {
    "mit-1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit0-1": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "mit-2": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-2b": "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software",
    "mit-3": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-4": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc-1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-1b": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-1": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-2": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd-0": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-1": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-2": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-3": "neither the name of nor the names of contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-4": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-5": "this software is provided by as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "apache-1": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    "apache-1b": "licensed under the apache license version 2 0 the license",
    "apache-2": "you may not use this file except in compliance with the license",
    "apache-3": "you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-3b": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "apache-4": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-5": "see the license for the specific language governing permissions and limitations under the license",
    "gpl3-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl3only-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3",
    "gpl2only-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2",
    "gpl-2": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-3": "see the gnu general public license for more details",
    "gpl-4": "you should have received a copy of the gnu general public license along with this program",
    "lgpl3-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl21-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl-3": "see the gnu lesser general public license for more details",
    "agpl3-1": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-3": "see the gnu affero general public license for more details",
    "mpl-1": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-2": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "epl2-1": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "epl1-1": "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at",
    "cc0-1": "to the extent possible under law has waived all copyright and related or neighboring rights to",
    "unlicense-1": "this is free and unencumbered software released into the public domain",
    "unlicense-2": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zlib-1": "this software is provided as is without any express or implied warranty",
    "zlib-2": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-1": "distributed under the boost software license version 1 0",
    "wtfpl-1": "this program is free software it comes without any warranty to the extent permitted by applicable law",
    "wtfpl-2": "you can redistribute it and or modify it under the terms of the do what the fuck you want to public license version 2 as published by sam hocevar",
    "artistic2-1": "this program is free software you can redistribute it and or modify it under the terms of the artistic license version 2 0",
    "reserved-1": "all rights reserved",
    "reserved-2": "no part of this work may be copied without permission",
}
# Licence rules, the longest sequences first.
RULES = [
    ("Apache-2.0", ("apache-1", "apache-3", "apache-5")),
    ("Apache-2.0", ("apache-1", "apache-3b", "apache-4", "apache-5")),
    ("Apache-2.0", ("apache-1b", "apache-2", "apache-3b", "apache-4", "apache-5")),
    ("Apache-2.0", ("apache-1b", "apache-2", "apache-4", "apache-5")),
    ("GPL-3.0-or-later", ("gpl3-1", "gpl-2", "gpl-3", "gpl-4")),
    ("GPL-2.0-or-later", ("gpl2-1", "gpl-2", "gpl-3", "gpl-4")),
    ("GPL-3.0-or-later", ("gpl3-1", "gpl-2", "gpl-3")),
    ("GPL-2.0-or-later", ("gpl2-1", "gpl-2", "gpl-3")),
    ("GPL-3.0-only", ("gpl3only-1", "gpl-2", "gpl-3")),
    ("GPL-2.0-only", ("gpl2only-1", "gpl-2", "gpl-3")),
    ("LGPL-3.0-or-later", ("lgpl3-1", "gpl-2", "lgpl-3")),
    ("LGPL-2.1-or-later", ("lgpl21-1", "gpl-2", "lgpl-3")),
    ("AGPL-3.0-or-later", ("agpl3-1", "gpl-2", "agpl-3")),
    ("BSD-4-Clause", ("bsd-0", "bsd-1", "bsd-2", "bsd-4", "bsd-3")),
    ("BSD-3-Clause", ("bsd-0", "bsd-1", "bsd-2", "bsd-3", "bsd-5")),
    ("BSD-3-Clause", ("bsd-0", "bsd-1", "bsd-2", "bsd-3")),
    ("BSD-3-Clause", ("bsd-1", "bsd-2", "bsd-3")),
    ("BSD-2-Clause", ("bsd-0", "bsd-1", "bsd-2", "bsd-5")),
    ("BSD-2-Clause", ("bsd-0", "bsd-1", "bsd-2")),
    ("BSD-2-Clause", ("bsd-1", "bsd-2")),
    ("MIT", ("mit-1", "mit-2", "mit-3", "mit-4")),
    ("MIT", ("mit-1", "mit-2b", "mit-3", "mit-4")),
    ("MIT", ("mit-1", "mit-2", "mit-3")),
    ("MIT", ("mit-1", "mit-2")),
    ("MIT-0", ("mit0-1", "mit-3", "mit-4")),
    ("MIT-0", ("mit0-1", "mit-3")),
    ("ISC", ("isc-1", "isc-2")),
    ("ISC", ("isc-1b", "isc-2")),
    ("0BSD", ("0bsd-1", "isc-2")),
    ("MPL-2.0", ("mpl-1", "mpl-2")),
    ("Unlicense", ("unlicense-1", "unlicense-2")),
    ("Zlib", ("zlib-1", "zlib-2")),
    ("WTFPL", ("wtfpl-1", "wtfpl-2")),
    ("All-rights-reserved", ("reserved-1", "reserved-2")),
    ("MIT", ("mit-1",)),
    ("ISC", ("isc-1",)),
    ("ISC", ("isc-1b",)),
    ("0BSD", ("0bsd-1",)),
    ("GPL-3.0-or-later", ("gpl3-1",)),
    ("GPL-2.0-or-later", ("gpl2-1",)),
    ("GPL-3.0-only", ("gpl3only-1",)),
    ("GPL-2.0-only", ("gpl2only-1",)),
    ("LGPL-3.0-or-later", ("lgpl3-1",)),
    ("LGPL-2.1-or-later", ("lgpl21-1",)),
    ("AGPL-3.0-or-later", ("agpl3-1",)),
    ("Apache-2.0", ("apache-1",)),
    ("Apache-2.0", ("apache-1b",)),
    ("MPL-2.0", ("mpl-1",)),
    ("EPL-2.0", ("epl2-1",)),
    ("EPL-1.0", ("epl1-1",)),
    ("CC0-1.0", ("cc0-1",)),
    ("Unlicense", ("unlicense-1",)),
    ("Unlicense", ("unlicense-2",)),
    ("BSL-1.0", ("boost-1",)),
    ("WTFPL", ("wtfpl-2",)),
    ("Artistic-2.0", ("artistic2-1",)),
    ("All-rights-reserved", ("reserved-1",)),
    ("All-rights-reserved", ("reserved-2",)),
]
# Names of licences after "licensed under", "released under", "under the terms of" and the like, in
# normalised words, with the identifiers that they mean.
NAMES = {
    "mit": "MIT",
    "x11": "X11",
    "isc": "ISC",
    "apache license version 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "apache 2 0": "Apache-2.0",
    "bsd 3 clause": "BSD-3-Clause",
    "3 clause bsd": "BSD-3-Clause",
    "new bsd": "BSD-3-Clause",
    "modified bsd": "BSD-3-Clause",
    "bsd 2 clause": "BSD-2-Clause",
    "2 clause bsd": "BSD-2-Clause",
    "simplified bsd": "BSD-2-Clause",
    "gnu general public license version 3 or later": "GPL-3.0-or-later",
    "gnu general public license version 2 or later": "GPL-2.0-or-later",
    "gnu general public license version 3": "GPL-3.0-only",
    "gnu general public license version 2": "GPL-2.0-only",
    "gnu general public license v3": "GPL-3.0-only",
    "gnu general public license v2": "GPL-2.0-only",
    "gpl v3": "GPL-3.0-only",
    "gplv3": "GPL-3.0-only",
    "gpl v2": "GPL-2.0-only",
    "gplv2": "GPL-2.0-only",
    "gnu lesser general public license version 2 1": "LGPL-2.1-only",
    "gnu lesser general public license version 3": "LGPL-3.0-only",
    "lgpl v3": "LGPL-3.0-only",
    "lgplv3": "LGPL-3.0-only",
    "gnu affero general public license version 3": "AGPL-3.0-only",
    "agpl v3": "AGPL-3.0-only",
    "agplv3": "AGPL-3.0-only",
    "mozilla public license version 2 0": "MPL-2.0",
    "mozilla public license v 2 0": "MPL-2.0",
    "mozilla public license 2 0": "MPL-2.0",
    "mpl 2 0": "MPL-2.0",
    "eclipse public license 2 0": "EPL-2.0",
    "eclipse public license v2 0": "EPL-2.0",
    "boost software license version 1 0": "BSL-1.0",
    "cc by nc sa 4 0": "CC-BY-NC-SA-4.0",
    "cc by nc nd 4 0": "CC-BY-NC-ND-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by sa 3 0": "CC-BY-SA-3.0",
    "cc by nd 4 0": "CC-BY-ND-4.0",
    "cc by 4 0": "CC-BY-4.0",
    "cc by 3 0": "CC-BY-3.0",
    "cc0 1 0": "CC0-1.0",
    "creative commons attribution noncommercial 4 0": "CC-BY-NC-4.0",
    "creative commons attribution sharealike 4 0": "CC-BY-SA-4.0",
    "creative commons attribution 4 0": "CC-BY-4.0",
    "creative commons zero": "CC0-1.0",
    "unlicense": "Unlicense",
    "zlib": "Zlib",
    "wtfpl": "WTFPL",
}
#: What may stand before a name, and between.
SAID = "licensed under|released under|distributed under|available under|provided under|covered by|subject to|under the terms of"
BETWEEN = "a|an|the|terms|of|conditions|creative commons"
#: What differs from notice to notice, in normalised words, in order: (pattern, replacement). No pattern looks around, so SQL engines run them alike.
SLOTS = [
    ("^(?:[a-z]|[0-9]{1,2}) (redistribution|neither|all advertising)", "$1"),
    ("^(?:copyright |c |[0-9]{4} )+.{0,200}? (all rights reserved|licensed under the apache|permission is hereby|permission to use|redistribution and use|this program is|this library is|this source code form|distributed under the boost)", "$1"),
    ("^all rights reserved (redistribution|permission|this program is free)", "$1"),
    ("^(?:this (?:library|file|software|package|module|work)|[a-z0-9]+) is free software you can", "this program is free software you can"),
    ("^(?:this (?:library|file|software|package|module)|[a-z0-9]+) is distributed in the hope", "this program is distributed in the hope"),
    ("^licensed to .{0,300}? licensed under", "licensed under"),
    ("^(?:licensed|this file is licensed|this software is licensed|this work is licensed) under the apache license version 2 0 the ?license", "licensed under the apache license version 2 0 the license"),
    ("https? www apache org", "http www apache org"),
    ("^neither the names? of .{1,200}? nor the names of (?:its |their |his |any )?contributors", "neither the name of nor the names of contributors"),
    ("^this software is provided by .{1,200}? as is and any express", "this software is provided by as is and any express"),
    ("^to the extent possible under law .{1,200}? has waived all copyright and related or neighboring rights to.*", "to the extent possible under law has waived all copyright and related or neighboring rights to"),
    ("^you should have received a copy of the gnu general public license along with .*", "you should have received a copy of the gnu general public license along with this program"),
    ("(is available at|you can obtain one at) http.*", "$1"),
    ("^(distributed under the boost software license version 1 0) .*", "$1"),
    ("(the do what the fuck you want to public license version 2 as published by sam hocevar).*", "$1"),
]
#: Every known sentence, name and tag holds one of these.
CUES = ("licens", "copyright", "warrant", "permission", "redistribut", "rights reserved", "public domain", "free software", "without permission", "neither the name", "the author", "apache", "mpl", "rights to", "gnu", "advertising", "anyone is free")
#: Before the cuts: stops after "v" and list numbers go, comment marks too, and an address or condition joins the line that leads to it.
SMOOTH = [(r"[#*/;%|]+[ \t]", " "), (r"(^|\n[ \t]*)([0-9])\.(\s)", "$1$2$3"), (r"(^|\s)v\.(\s)", "$1v$2"), (r"\n\s*\n(\s*(?:https?:|you may not|unless))", " $1")]
AT_LINES, ACROSS_LINES = r"[.!?]+[\"')]*\s+|\n+", r"[.!?]+[\"')]*\s+|\n\s*\n"
TAG = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)"


def _replaced(s: Column, pairs: list[tuple[str, str]]) -> Column:
    for pattern, to in pairs:
        s = F.regexp_replace(s, pattern, to)
    return s


def _plain(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def _identifiers(low: Column, cut: str) -> Column:
    known = F.create_map(*[F.lit(x) for name, sentence in SENTENCES.items() for x in (sentence, name)])
    named = F.transform(F.split(_replaced(low, SMOOTH), cut), lambda s: F.try_element_at(known, _replaced(_plain(s), SLOTS)))
    return F.filter(named, lambda x: x.isNotNull())


def _name_pattern() -> str:
    """Of names that begin alike the longest counts."""
    return f"(?:{SAID}) (?:(?:{BETWEEN}) )*({'|'.join(sorted(NAMES, key=lambda n: (-len(n), n)))})(?: |$)"


def _named(low: Column) -> Column:
    """Identifiers of the licences that a text names."""
    means = F.create_map(*[F.lit(x) for n in NAMES for x in (n, NAMES[n])])
    return F.transform(F.regexp_extract_all(_plain(low), F.lit(_name_pattern()), F.lit(1)), lambda x: F.element_at(means, x))


def _sequence(ids: Column) -> Column:
    """,a,,b, for the identifiers a and b: rules are found as texts in it."""
    return F.array_join(F.transform(ids, lambda x: F.concat(F.lit(","), x, F.lit(","))), "")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_sentences, sentence_ids, licences): identifiers known in either cut and licences, both sorted."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    cue = F.lit(False)
    for c in CUES:
        cue = cue | F.contains(low, F.lit(c))
    none = F.array().cast("array<string>")
    kept = lambda c: F.when(cue, c).otherwise(none)
    df = df.select(key, kept(_identifiers(low, AT_LINES)).alias("a"), kept(_identifiers(low, ACROSS_LINES)).alias("b"), kept(F.concat(_named(low), F.regexp_extract_all(t, F.lit(TAG), F.lit(1)))).alias("c"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f",{x}," for x in ids)).alias("pattern")) for name, ids in RULES])
    start = F.struct(F.concat_ws("|", _sequence(F.col("a")), _sequence(F.col("b"))).alias("left"), none.alias("found"))
    step = lambda s, r: F.struct(F.replace(s["left"], r["pattern"], F.lit("|")).alias("left"), F.when(F.contains(s["left"], r["pattern"]), F.array_append(s["found"], r["name"])).otherwise(s["found"]).alias("found"))
    found = F.when(F.size("a") + F.size("b") > 0, F.aggregate(rules, start, step, lambda s: s["found"])).otherwise(none)
    ids = F.array_distinct(F.concat("a", "b"))
    return df.select(key, F.size(ids).cast("long").alias("n_sentences"), F.array_join(F.array_sort(ids), ";").alias("sentence_ids"), F.array_join(F.array_sort(F.array_distinct(F.concat(found, "c"))), ";").alias("licences"))


def _sql(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def scan_sql(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """The same in DuckDB SQL."""
    known = ", ".join(f"({_sql(s)}, '{n}')" for n, s in SENTENCES.items())
    means = ", ".join(f"({_sql(n)}, '{i}')" for n, i in NAMES.items())

    def replaced(s: str, pairs: list[tuple[str, str]]) -> str:
        for pattern, to in pairs:
            s = f"regexp_replace({s}, {_sql(pattern)}, {_sql(to.replace('$', chr(92)))}, 'g')"
        return s

    plain = lambda s: f"trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))"
    cut = lambda pattern: f"list_filter(list_transform(regexp_split_to_array(smooth, {_sql(pattern)}), lambda s: known[{replaced(plain('s'), SLOTS)}]), lambda x: x IS NOT NULL)"
    seq = lambda c: f"array_to_string(list_transform({c}, lambda x: ',' || x || ','), '')"
    steps, names = [], []
    for i, (name, ids) in enumerate(RULES):
        pattern = "".join(f",{x}," for x in ids)
        steps.append(f"s{i + 1} AS (SELECT * EXCLUDE (seq), replace(seq, '{pattern}', '|') AS seq, contains(seq, '{pattern}') AS f{i} FROM s{i})")
        names.append(f"CASE WHEN f{i} THEN '{name}' END")
    cue = " OR ".join(f"contains(low, '{c}')" for c in CUES)
    return f"""WITH m AS (SELECT map_from_entries(list((s, n))) AS known FROM (VALUES {known}) v(s, n)), e AS (SELECT map_from_entries(list((s, n))) AS means FROM (VALUES {means}) v(s, n)),
d AS (SELECT {key}, coalesce({text}, '') AS t, lower(coalesce({text}, '')) AS low FROM {source}),
l AS (SELECT {key}, t, low, {replaced("low", SMOOTH)} AS smooth FROM d WHERE {cue}),
i AS (SELECT {key}, {cut(AT_LINES)} AS a, {cut(ACROSS_LINES)} AS b, list_concat(list_transform(regexp_extract_all({plain("low")}, {_sql(_name_pattern())}, 1), lambda x: means[x]), regexp_extract_all(t, {_sql(TAG)}, 1)) AS c FROM l, m, e
 UNION ALL SELECT {key}, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[] FROM d WHERE NOT ({cue})),
s0 AS (SELECT {key}, c, list_sort(list_distinct(list_concat(a, b))) AS ids, {seq("a")} || '|' || {seq("b")} AS seq FROM i),
{", ".join(steps)}
SELECT {key}, CAST(len(ids) AS BIGINT) AS n_sentences, array_to_string(ids, ';') AS sentence_ids,
array_to_string(list_sort(list_distinct(list_concat(list_filter([{", ".join(names)}], lambda x: x IS NOT NULL), c))), ';') AS licences FROM s{len(RULES)}"""

"""License scans by sentence rules.

A document's sentences are normalised and mapped to identifiers of known licence
sentences; the identifiers, in order, are matched against an ordered list of
licence rules. A rule that matches consumes its identifiers, so the rules listed
first (the longer ones) win. Everything is an expression of one row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, texts

#: Known licence sentences, by identifier; they are normalised as documents are.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-named": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-not-use": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-fitness": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "public-domain": "This work is in the public domain.",
    "mpl2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "epl2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "bsl1": "Distributed under the Boost Software License, Version 1.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "rights-reserved": "All rights reserved.",
}
#: Licence rules in order of precedence: (licence, its sentences in order).
RULES = [
    ("Apache-2.0", ["apache-named", "apache-not-use", "apache-copy", "apache-unless", "apache-see"]),
    ("Apache-2.0", ["apache-named", "apache-not-use", "apache-copy"]),
    ("Apache-2.0", ["apache-short"]),
    ("Apache-2.0", ["apache-named"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-licensed"]),
    ("ISC", ["isc-grant"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-fitness", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-fitness", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC0-1.0", ["cc0"]),
    ("Public-Domain", ["public-domain"]),
    ("MPL-2.0", ["mpl2"]),
    ("EPL-2.0", ["epl2"]),
    ("BSL-1.0", ["bsl1"]),
    ("Unlicense", ["unlicense"]),
    ("LicenseRef-All-Rights-Reserved", ["rights-reserved"]),
]
END = r"([.;:!?])[ \t\r]+"


def normal(sentence: str) -> str:
    """As the expressions below do: runs of other than ASCII letters and digits become one space, letters lower case."""
    return " ".join("".join(c.lower() if c.isascii() and c.isalnum() else " " for c in sentence).split())


def sentences(text: Column) -> Column:
    """Normalised sentences: a text ends one at a line break, or at . ; : ! ? before white space. Null has none; empty ones are left out."""
    broken = F.regexp_replace(F.coalesce(text, F.lit("")), END, "$1\n")
    plain = F.lower(F.regexp_replace(broken, r"[^A-Za-z0-9\n]+", " "))
    return F.array_remove(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), "")


def found(ss: Column, known: list[str]) -> Column:
    """Known sentences, normalised, in the order of the document's: each from the start of a piece to the end of one, the longest that is there."""
    forms = "|".join(s.replace(" ", "[ \n]") for s in sorted(known, key=lambda s: (-len(s), s)))
    text = F.concat(F.lit("\n"), F.array_join(ss, "\n"), F.lit("\n"))
    return F.transform(F.regexp_extract_all(text, F.lit(f"\n({forms or '(?!)'})(?=\n)"), F.lit(1)), lambda x: F.translate(x, "\n", " "))


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_sentences, n_known, n_matches, licenses (distinct, in order of the rules), unmatched (known sentences that no rule took, as <id>).

    A known sentence may be one piece of the document or several that follow each other, so it may be
    wrapped, with comment marks, or hold breaks of sentences or blank lines (as the Apache header does
    before its URL). It counts once in n_known; n_sentences counts the pieces.
    Unknown sentences between known ones don't break a rule's sequence. Null and empty texts have
    no sentences and no licences. Whole texts are scanned, however long. Repeated rows and null ids each get
    their row. An empty table gives an empty one; only the named columns are read, so others can't clash.
    """
    known, rules = known or SENTENCES, rules or RULES
    ids = {normal(s): k for k, s in known.items() if normal(s)}
    lookup = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    d = texts(docs, id_col, text_col).select("doc_id", sentences(F.col("text")).alias("ss"))
    d = d.select("doc_id", F.size("ss").cast("long").alias("n_sentences"), found(F.col("ss"), list(ids)).alias("kk"))
    d = d.withColumn("seq", F.array_join(F.transform("kk", lambda s: F.concat(F.lit("<"), F.element_at(lookup, s), F.lit(">"))), ""))
    table_ = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in seq)).alias("pattern")) for name, seq in rules])
    start = F.struct(F.col("seq").alias("seq"), F.array().cast("array<string>").alias("names"), F.lit(0).cast("long").alias("n"))

    def apply(acc: Column, rule: Column) -> Column:
        left = F.replace(acc["seq"], rule["pattern"], F.lit("|"))
        times = ((F.length(acc["seq"]) - F.length(left)) / (F.length(rule["pattern"]) - 1)).cast("long")
        return F.when(F.instr(acc["seq"], rule["pattern"]) == 0, acc).otherwise(
            F.struct(left.alias("seq"), F.array_union(acc["names"], F.array(rule["name"])).alias("names"), (acc["n"] + times).alias("n"))
        )

    d = d.withColumn("m", F.when(F.col("seq") == "", start).otherwise(F.aggregate(table_, start, apply)))
    return d.select(
        "doc_id",
        "n_sentences",
        F.size("kk").cast("long").alias("n_known"),
        F.col("m.n").alias("n_matches"),
        F.array_join("m.names", ",").alias("licenses"),
        F.replace(F.col("m.seq"), F.lit("|"), F.lit("")).alias("unmatched"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle(known: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> str:
    """The same in SQL. Pieces are set apart by two breaks, so that neighbours don't compete for one."""
    sql = ",\n".join(f"('{normal(s)}', '{k}')" for k, s in known.items())
    forms = "|".join(normal(s).replace(" ", "(?: |\\n\\n)") for s in sorted(known.values(), key=lambda s: (-len(normal(s)), normal(s))))
    steps, names, counts, prev = [], [], [], "q"
    for i, (name, seq) in enumerate(rules):
        pattern = "".join(f"<{x}>" for x in seq)
        steps.append(f"r{i} AS (SELECT * EXCLUDE (seq), (len(seq) - len(replace(seq, '{pattern}', '|'))) // {len(pattern) - 1} AS c{i}, replace(seq, '{pattern}', '|') AS seq FROM {prev})")
        names.append(f"CASE WHEN c{i} > 0 THEN '{name}' END")
        counts.append(f"c{i}")
        prev = f"r{i}"
    first = list(dict.fromkeys(name for name, _ in rules))
    any_of = {n: " + ".join(f"c{i}" for i, (name, _) in enumerate(rules) if name == n) for n in first}
    order = {n: "least(" + ", ".join(f"CASE WHEN c{i} > 0 THEN {i} ELSE 99 END" for i, (name, _) in enumerate(rules) if name == n) + ")" for n in first}
    listed = ", ".join(f"CASE WHEN {any_of[n]} > 0 THEN {{'o': {order[n]}, 'n': '{n}'}} END" for n in first)
    return f"""
WITH known(s, id) AS (VALUES {sql}),
d AS (SELECT doc_id, list_filter(list_transform(string_split(lower(regexp_replace(regexp_replace(coalesce(text, ''), '{END}', '\\1' || chr(10), 'g'), '[^A-Za-z0-9\\n]+', ' ', 'g')), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM documents),
e AS (SELECT doc_id, replace(unnest(hits), chr(10) || chr(10), ' ') AS s, unnest(range(1, len(hits) + 1)) AS i
      FROM (SELECT doc_id, regexp_extract_all(chr(10) || array_to_string(ss, chr(10) || chr(10)) || chr(10), '\\n({forms})\\n', 1) AS hits FROM d)),
k AS (SELECT doc_id, count(*) AS n_known, string_agg('<' || id || '>', '' ORDER BY i) AS seq FROM e JOIN known USING (s) GROUP BY doc_id),
q AS (SELECT doc_id, len(ss) AS n_sentences, coalesce(n_known, 0) AS n_known, coalesce(seq, '') AS seq FROM d LEFT JOIN k USING (doc_id)),
{",".join(steps)}
SELECT doc_id, n_sentences, n_known, ({" + ".join(counts)})::BIGINT AS n_matches,
  array_to_string(list_transform(list_sort(list_filter([{listed}], lambda x: x IS NOT NULL)), lambda x: x.n), ',') AS licenses, replace(seq, '|', '') AS unmatched
FROM {prev}
"""


ORACLE = oracle()

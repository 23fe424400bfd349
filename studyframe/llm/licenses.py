"""License scans by sentence rules, in built-in Spark functions only.

A text is cut into sentences; those that speak of licences are normalised (small letters, runs of other characters than letters, digits, dots and plus signs as one space) and mapped to
the identifier of the known licence sentence they match, or to ``UNKNOWN``. The identifiers of a text form a sequence, and ordered licence rules
replace the parts of it they match by a licence, longer rules first; identifiers left over are sentences without a full licence.

Each text is handled by itself in one projection, so there is no shuffle and a very common licence line costs no more than any other.

Cases: null and empty texts, and texts without a licence-like sentence, have status ``none``; texts of any length are read whole; repeated rows and tied ids each give a
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that mark a licence-like sentence.
MARKS = (r"(?i)licen[cs]e|copyright|copyleft|warrant|redistribut|permission|spdx|all rights reserved|creative commons|public domain|cc0|cc by"
         r"|liable|liability|conditions|as is")

# Known licence sentences in normalised form, first match wins.
SENTENCES = [
    ("SPDX_MIT", r"^.{0,20}spdx license identifier mit\b"),
    ("SPDX_APACHE2", r"^.{0,20}spdx license identifier apache 2\.0\b"),
    ("SPDX_GPL3", r"^.{0,20}spdx license identifier l?gpl 3\.0\b"),
    ("SPDX_GPL2", r"^.{0,20}spdx license identifier l?gpl 2\.[01]\b"),
    ("SPDX_BSD3", r"^.{0,20}spdx license identifier bsd 3 clause\b"),
    ("SPDX_BSD2", r"^.{0,20}spdx license identifier bsd 2 clause\b"),
    ("SPDX_OTHER", r"^.{0,20}spdx license identifier "),
    ("MIT_REF", r"\b(released|licensed|distributed|available|provided|published) under (the )?(terms of the )?mit license\b"),
    ("MIT_TITLE", r"^(the )?mit license( mit)?$"),
    ("MIT_GRANT", r"^permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("MIT_KEEP", r"^the above copyright notice and this permission notice shall be included in all copies"),
    ("MIT_AS_IS", r"^the software is provided as is without warranty of any kind"),
    ("MIT_LIABLE", r"^in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("ISC_GRANT", r"^permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("APACHE2_REF", r"\b(released|licensed|distributed|available|provided|published) under the (terms of the )?apache license,? version 2\.0\b"),
    ("APACHE2_USE", r"^you may not use this file except in compliance with the license"),
    ("APACHE2_COPY", r"^you may obtain a copy of the license at"),
    ("APACHE2_AS_IS", r"software distributed under the license is distributed on an as is basis"),
    ("APACHE2_SEE", r"^see the license for the specific language governing permissions and limitations under the license"),
    ("AGPL3_REF", r"\bgnu affero general public license,? (version|v) ?3\b"),
    ("LGPL3_REF", r"\bgnu lesser general public license,? (version|v) ?3\b"),
    ("LGPL2_REF", r"\bgnu (lesser|library) general public license,? (version|v) ?2"),
    ("GPL3_REF", r"\bgnu general public license,? (version|v) ?3\b"),
    ("GPL2_REF", r"\bgnu general public license,? (version|v) ?2\b"),
    ("GPL_FREE", r"^this program is free software"),
    ("GPL_TERMS", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by"),
    ("GPL_VERSION3", r"^either version 3 of the license or at your option any later version"),
    ("GPL_VERSION2", r"^either version 2 of the license or at your option any later version"),
    ("GPL_HOPE", r"^this program is distributed in the hope that it will be useful but without any warranty"),
    ("BSD_REDIST", r"^redistribution and use in source and binary forms with or without modification are permitted"),
    ("BSD_SOURCE", r"redistributions of source code must retain the above copyright notice"),
    ("BSD_BINARY", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSD_NAME", r"^neither the name of .* may be used to endorse or promote products derived from this software"),
    ("BSD_AS_IS", r"^this software is provided by .*as is and any express or implied warranties"),
    ("MPL2_REF", r"\bmozilla public license,? (version|v\.?) ?2\.0\b"),
    ("CC0_REF", r"\bcc0 1\.0\b|\bcc0\b"),
    ("CC_BY_NC_ND", r"\bcc by nc nd ?[1-4]\.0\b|\bcreative commons attribution noncommercial noderivatives\b"),
    ("CC_BY_NC_SA", r"\bcc by nc sa ?[1-4]\.0\b|\bcreative commons attribution noncommercial sharealike\b"),
    ("CC_BY_NC", r"\bcc by nc ?[1-4]\.0\b|\bcreative commons attribution noncommercial\b"),
    ("CC_BY_SA", r"\bcc by sa ?[1-4]\.0\b|\bcreative commons attribution sharealike\b"),
    ("CC_BY_ND", r"\bcc by nd ?[1-4]\.0\b|\bcreative commons attribution noderivatives\b"),
    ("CC_BY", r"\bcc by ?[1-4]\.0\b|\bcreative commons attribution\b"),
    ("PUBLIC_DOMAIN", r"\b(released|placed|dedicated) (in|into|to) the public domain\b|^this is free and unencumbered software released into the public domain"),
    ("ALL_RIGHTS", r"\ball rights reserved\b"),
    ("COPYRIGHT", r"^copyright (c )?([0-9]{4}|by )"),
]

# Ordered rules over identifier sequences, each identifier in angle brackets.
RULES = [
    ("MIT", r"(<MIT_TITLE>)?(<COPYRIGHT>)?(<ALL_RIGHTS>)?<MIT_GRANT><MIT_KEEP><MIT_AS_IS>(<MIT_LIABLE>)?"),
    ("ISC", r"(<COPYRIGHT>)?<ISC_GRANT>"),
    ("Apache-2.0", r"(<COPYRIGHT>)?(<ALL_RIGHTS>)?<APACHE2_REF>(<APACHE2_USE>)?(<APACHE2_COPY>)?(<APACHE2_AS_IS>)?(<APACHE2_SEE>)?"),
    ("BSD-3-Clause", r"(<COPYRIGHT>)?(<ALL_RIGHTS>)?<BSD_REDIST><BSD_SOURCE><BSD_BINARY><BSD_NAME>(<BSD_AS_IS>)?"),
    ("BSD-2-Clause", r"(<COPYRIGHT>)?(<ALL_RIGHTS>)?<BSD_REDIST><BSD_SOURCE><BSD_BINARY>(<BSD_AS_IS>)?"),
    ("GPL-3.0-or-later", r"(<GPL_FREE>)?<GPL_TERMS><GPL_VERSION3>(<GPL_HOPE>)?"),
    ("GPL-2.0-or-later", r"(<GPL_FREE>)?<GPL_TERMS><GPL_VERSION2>(<GPL_HOPE>)?"),
    ("AGPL-3.0", r"<AGPL3_REF>"),
    ("LGPL-3.0", r"<LGPL3_REF>"),
    ("LGPL-2.1", r"<LGPL2_REF>"),
    ("GPL-3.0", r"<(GPL3_REF|SPDX_GPL3)>"),
    ("GPL-2.0", r"<(GPL2_REF|SPDX_GPL2)>"),
    ("MIT", r"<(MIT_REF|SPDX_MIT|MIT_TITLE)>"),
    ("Apache-2.0", r"<SPDX_APACHE2>"),
    ("BSD-3-Clause", r"<SPDX_BSD3>"),
    ("BSD-2-Clause", r"<SPDX_BSD2>"),
    ("MPL-2.0", r"<MPL2_REF>"),
    ("CC0-1.0", r"<CC0_REF>"),
    ("CC-BY-NC-ND", r"<CC_BY_NC_ND>"),
    ("CC-BY-NC-SA", r"<CC_BY_NC_SA>"),
    ("CC-BY-NC", r"<CC_BY_NC>"),
    ("CC-BY-SA", r"<CC_BY_SA>"),
    ("CC-BY-ND", r"<CC_BY_ND>"),
    ("CC-BY", r"<CC_BY>"),
    ("Public-Domain", r"<PUBLIC_DOMAIN>"),
    ("All-Rights-Reserved", r"(<COPYRIGHT>)?<ALL_RIGHTS>"),
]


def _identifier(sentence):
    out = None
    for name, pattern in SENTENCES:
        out = F.when(sentence.rlike(pattern), F.lit(name)) if out is None else out.when(sentence.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit("UNKNOWN"))


def _normal(sentence):
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(sentence), "[^a-z0-9.+]+", " "), r"\.+( |$)", " "))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licenses, n_licenses, status): status is none, known, partial or unknown."""
    # a line that goes on in small letters belongs to the sentence before it; sentences end at a line's end or after . ! ? ;
    joined = F.regexp_replace("text", r"\n[ \t]*([a-z(])", " $1")
    cut = F.split(F.regexp_replace(joined, r"([.!?;])[ \t]+", "$1\n"), "\n")
    ids = F.transform(F.filter(cut, lambda s: s.rlike(MARKS)), lambda s: _identifier(_normal(s)))
    out = docs.select("doc_id", F.when(F.col("text").rlike(MARKS), ids).otherwise(F.array().cast("array<string>")).alias("_ids"))
    sequence = F.when(F.size("_ids") > 0, F.concat(F.lit("<"), F.array_join("_ids", "><"), F.lit(">"))).otherwise(F.lit(""))
    out = out.select("doc_id", F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", " ").alias("sentence_ids"), sequence.alias("_rest"))
    rest = F.col("_rest")
    for name, pattern in RULES:
        rest = F.regexp_replace(rest, pattern, f"={name}=")
    out = out.withColumn("_rest", F.when(F.col("_rest") != "", rest).otherwise(F.lit("")))
    found = F.regexp_extract_all("_rest", F.lit("=([^=]+)="), F.lit(1))
    left = F.regexp_replace(F.regexp_replace("_rest", "=[^=]+=", ""), "<UNKNOWN>|<COPYRIGHT>", "")
    status = (F.when(F.col("n_sentences") == 0, "none").when(F.size(found) > 0, F.when(left == "", "known").otherwise("partial"))
              .otherwise(F.when(left == "", "unknown").otherwise("partial")))
    return out.select("doc_id", "n_sentences", "sentence_ids", F.array_join(found, ",").alias("licenses"), F.size(found).cast("long").alias("n_licenses"), status.alias("status"))


def sql(documents: str = "documents") -> str:
    """The same scan in DuckDB's SQL, from the same fixed values."""
    text = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN regexp_matches(s, {text(p)}) THEN {text(n)}" for n, p in SENTENCES)
    rest = "seq"
    for name, pattern in RULES:
        rest = f"regexp_replace({rest}, {text(pattern)}, {text(f'={name}=')}, 'g')"
    normal = r"trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.+]+', ' ', 'g'), '\.+( |$)', ' ', 'g'))"
    cut = r"string_split(regexp_replace(regexp_replace(text, '\n[ \t]*([a-z(])', ' \1', 'g'), '([.!?;])[ \t]+', E'\\1\n', 'g'), E'\n')"
    return f"""
WITH a AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), {text(MARKS)}) THEN
             list_transform(list_transform(list_filter({cut}, lambda s: regexp_matches(s, {text(MARKS)})), lambda s: {normal}), lambda s: CASE {cases} ELSE 'UNKNOWN' END)
           ELSE [] END AS ids FROM {documents}),
b AS (SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ' ') AS sentence_ids,
             CASE WHEN len(ids) > 0 THEN '<' || array_to_string(ids, '><') || '>' ELSE '' END AS seq FROM a),
c AS (SELECT doc_id, n_sentences, sentence_ids, {rest} AS rest FROM b),
d AS (SELECT *, regexp_extract_all(rest, '=([^=]+)=', 1) AS found,
             regexp_replace(regexp_replace(rest, '=[^=]+=', '', 'g'), '<UNKNOWN>|<COPYRIGHT>', '', 'g') AS remain FROM c)
SELECT doc_id, n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(array_to_string(found, ','), '') AS licenses, len(found) AS n_licenses,
       CASE WHEN n_sentences = 0 THEN 'none' WHEN len(found) > 0 THEN CASE WHEN remain = '' THEN 'known' ELSE 'partial' END
            WHEN remain = '' THEN 'unknown' ELSE 'partial' END AS status
FROM d"""

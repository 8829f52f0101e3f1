"""Licence scan by recognition of sentences and rules over their sequences.

Texts are normalised (lower case, comment signs and line breaks taken out) and cut into
sentences. Each sentence that a known pattern describes yields the pattern's identifier;
the identifiers of a text, in order, are matched against licence rules in their order, the
more specific first. What a rule has matched is used up, so that the words of one licence
are not counted for another. All of it happens inside the row, with built-in functions.

A sentence that speaks of being licensed, but names no licence that a pattern knows, has an
identifier of its own (`some-licence`), which no rule uses.

Defined cases: a null or empty text has no sentence and no licence; repeated rows are each
scanned; sentences that belong to no rule are counted as left over, which marks texts that
speak of an unknown licence; an empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import text_or_empty

COMMENT = r"(^|\n)[ \t]*(?://+|/?\*+/?|#+|;+|--+|<!--|dnl |rem )"

#: Identifiers of sentences, and what describes them in normalised text.
SENTENCES = (
    ("spdx", r"spdx-license-identifier: *[a-z0-9.+-]+"),
    ("copyright", r"(?:copyright|\(c\)|©).{0,40}[0-9]{4}"),
    ("all-rights", r"all rights reserved"),
    ("apache-2-named", r"apache (?:software )?licen[cs]e,? ?\(?(?:v(?:ersion)?\.? ?)?2(?:\.0)?\b|\bapache[ -]2(?:\.0)?\b"),
    ("apache-obtain", r"you may obtain a copy of the licen[cs]e at"),
    ("apache-except", r"you may not use this file except in compliance with the licen[cs]e"),
    ("apache-as-is", r"distributed under the licen[cs]e is distributed on an .?as is.? basis"),
    ("mit-named", r"(?:licensed|released|distributed|available|covered).{0,40}\bmit\b.{0,4}licen[cs]e|\bmit licen[cs]e\b"),
    ("mit-grant", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("mit-notice", r"above copyright notice and this permission notice shall be included"),
    ("as-is", r"software is provided .?as is.?,? without warranty of any kind"),
    ("no-liability", r"in no event shall the .{0,80}be liable"),
    ("bsd-3-named", r"\bbsd[ -](?:3|three)[ -]clause\b|\b(?:3|three)[ -]clause bsd\b"),
    ("bsd-2-named", r"\bbsd[ -](?:2|two)[ -]clause\b|\b(?:2|two)[ -]clause bsd\b"),
    ("bsd-named", r"(?:licensed|released|distributed|available|covered).{0,40}\bbsd\b|\bbsd(?:-style)? licen[cs]e\b"),
    ("bsd-grant", r"redistribution and use in source and binary forms.{0,60}are permitted"),
    ("bsd-source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd-binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-endorse", r"neither the name .{0,120}may be used to endorse"),
    ("bsd-as-is", r"this software is provided by .{0,120}as is"),
    ("isc-grant", r"permission to use, copy, modify, and/?(?:or)? distribute this software for any purpose"),
    ("gpl-named", r"gnu general public licen[cs]e|\bgnu gpl\b|\bgpl[ -]?v?[123]\b"),
    ("lgpl-named", r"gnu (?:lesser|library) general public licen[cs]e|\blgpl[ -]?v?[23]"),
    ("agpl-named", r"gnu affero general public licen[cs]e|\bagpl[ -]?v?[0-9]"),
    ("gnu-version-1", r"(?:general public licen[cs]e|\b[al]?gpl).{0,40}(?:version|v)\.? ?1|\b[al]?gpl[ -]1|version 1 of the licen[cs]e"),
    ("gnu-version-2", r"(?:general public licen[cs]e|\b[al]?gpl).{0,40}(?:version|v)\.? ?2|\b[al]?gpl[ -]2|version 2 of the licen[cs]e"),
    ("gnu-version-3", r"(?:general public licen[cs]e|\b[al]?gpl).{0,40}(?:version|v)\.? ?3|\b[al]?gpl[ -]3|version 3 of the licen[cs]e"),
    ("gnu-later", r"or .{0,20}any later version"),
    ("gnu-useful", r"distributed in the hope that it will be useful"),
    ("gnu-copy", r"you should have received a copy of the gnu"),
    ("mpl-2", r"mozilla public licen[cs]e,? ?(?:version|v)?\.? ?2"),
    ("epl", r"eclipse public licen[cs]e"),
    ("cc-by", r"\bcc[ -]by(?: |-)?(?:[0-9]|licen|$)|creative commons attribution(?: [0-9]| international| licen)"),
    ("cc-by-sa", r"\bcc[ -]by-sa\b|creative commons attribution-?share-?alike"),
    ("cc-by-nc", r"\bcc[ -]by-nc\b(?!-)|creative commons attribution-?non-?commercial(?: [0-9]| international| licen)"),
    ("cc-by-nc-sa", r"\bcc[ -]by-nc-sa\b"),
    ("cc-by-nd", r"\bcc[ -]by(?:-nc)?-nd\b"),
    ("cc0", r"\bcc0\b|creative commons zero"),
    ("unlicense", r"free and unencumbered software released into the public domain"),
    ("public-domain", r"(?:placed|released|dedicated|is) (?:in|into|to) the public domain"),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)|proprietary and confidential"),
    ("some-licence", r"(?:licensed|released|distributed) under|terms of (?:the|this) licen[cs]e|see (?:the )?licen[cs]e"),
)
# RE2 and Java agree on these patterns but for look-ahead, which the twin in SQL can't use
SENTENCES = tuple((k, p.replace(r"(?!-)", r"(?:[^-]|$)")) for k, p in SENTENCES)

#: In normalised text, whatever a branch of a pattern above matches holds one of these.
CUES = (
    "licen", "copyright", "apache 2", "apache-2", "(c)", "©", "gpl", "permission", "warrant", "liab", "redistribution", "spdx-", "bsd", "public domain", "cc by", "cc-by", "cc0", "creative commons", "all rights reserved",
    "neither the name", "software is provided by", "any later version", "in the hope that it", "copy of the gnu", "unauthori", "proprietary and confidential", "released under", "distributed under",
)

#: Licence rules in order; identifiers of a rule follow each other with any others between.
RULES = (
    ("Unlicense", ("unlicense", "public-domain")),
    ("Unlicense", ("unlicense",)),
    ("AGPL-3.0", ("agpl-named", "gnu-version-3")),
    ("AGPL-1.0", ("agpl-named", "gnu-version-1")),
    ("AGPL", ("agpl-named",)),
    ("LGPL-3.0", ("lgpl-named", "gnu-version-3")),
    ("LGPL-2.1", ("lgpl-named", "gnu-version-2")),
    ("LGPL", ("lgpl-named",)),
    ("GPL-3.0-or-later", ("gpl-named", "gnu-version-3", "gnu-later")),
    ("GPL-2.0-or-later", ("gpl-named", "gnu-version-2", "gnu-later")),
    ("GPL-3.0", ("gpl-named", "gnu-version-3")),
    ("GPL-2.0", ("gpl-named", "gnu-version-2")),
    ("GPL-1.0", ("gpl-named", "gnu-version-1")),
    ("GPL", ("gpl-named",)),
    ("Apache-2.0", ("apache-2-named", "apache-except", "apache-obtain", "apache-as-is")),
    ("Apache-2.0", ("apache-2-named",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is")),
    ("MIT", ("mit-grant",)),
    ("MIT", ("mit-named",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-3-named", "bsd-named")),
    ("BSD-3-Clause", ("bsd-3-named",)),
    ("BSD-2-Clause", ("bsd-2-named", "bsd-named")),
    ("BSD-2-Clause", ("bsd-2-named",)),
    ("BSD", ("bsd-grant",)),
    ("BSD", ("bsd-named",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl-2",)),
    ("EPL", ("epl",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-NC-SA", ("cc-by-nc-sa",)),
    ("CC-BY-ND", ("cc-by-nd",)),
    ("CC-BY-NC", ("cc-by-nc",)),
    ("CC-BY-SA", ("cc-by-sa",)),
    ("CC-BY", ("cc-by",)),
    ("Public-Domain", ("public-domain",)),
    ("Proprietary", ("proprietary",)),
)


SPDX = r"spdx-license-identifier:[ \t]*([a-z0-9.+-]+)"
#: An identifier that is given outright names its licence; the patterns of sentences don't read it.
GIVEN = r"spdx-license-identifier: *[a-z0-9.+-]+(?: (?:or|and|with) [a-z0-9.+-]+)*"
TAKEN = "spdx-license-identifier:x"


#: Identifiers of sentences that name a licence or grant one; beside these, being licensed says nothing more.
NAMING = tuple(dict.fromkeys(i for _, ids in RULES for i in ids if not i.startswith("gnu-")))


def rule_pattern(ids: tuple[str, ...]) -> str:
    """Over a text like ',a,,b,,c,': the identifiers in order; what stands between is captured.

    Every identifier has a comma of its own on both sides, so that neighbours match apart.
    """
    return "((?:,[a-z0-9-]+,)*?)".join(f",{i}," for i in ids)


def rule_rest(ids: tuple[str, ...], group: str = "$") -> str:
    """What a match leaves: the identifiers that stood between those of the rule."""
    return "".join(f"{group}{k}" for k in range(1, len(ids)))


def cued(plain: Column) -> Column:
    """Whether normalised text holds a cue; without one it has no known sentence."""
    return reduce(or_, [plain.contains(c) for c in CUES])


def sentence_ids(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order."""
    plain = F.lower(text)
    plain = F.regexp_replace(plain, COMMENT, "$1 ")
    plain = F.regexp_replace(F.regexp_replace(plain, r"[ \t\r\n\x0B\f]+", " "), GIVEN, TAKEN)
    cut = F.split(F.regexp_replace(plain, r"([.!?;]) ", "$1\n"), "\n")
    cues = F.filter(cut, cued)
    named = lambda s: F.filter(F.array(*[F.when(s.rlike(p), F.lit(k)) for k, p in SENTENCES]), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    clear = lambda ids: F.filter(ids, lambda x: (x != "some-licence") | ~F.arrays_overlap(ids, F.lit(list(NAMING))))
    return F.when(cued(plain), F.flatten(F.transform(F.transform(cues, named), clear))).otherwise(none)


def oracle_sql() -> str:
    """The scan of `documents` in SQL, written from the same sentences and rules."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    named = ", ".join(f"case when regexp_matches(s, {quoted(p)}) then {quoted(k)} end" for k, p in SENTENCES)
    steps = []
    for k, (name, ids) in enumerate(RULES):
        fits = f"regexp_matches(l, {quoted(rule_pattern(ids))})"
        steps.append(
            f"""r{k + 1} as (select doc_id, ids, spdx,
  case when {fits} then regexp_replace(l, {quoted(rule_pattern(ids))}, {quoted(rule_rest(ids, chr(92)))}, 'g') else l end as l,
  case when {fits} and not list_contains(found, {quoted(name)}) then list_append(found, {quoted(name)}) else found end as found from r{k})"""
        )
    return f"""
with plain as (
  select doc_id, lower(coalesce(text, '')) as body,
    regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), {quoted(COMMENT)}, '\\1 ', 'g'), '[ \\t\\r\\n\\x0B\\f]+', ' ', 'g'), {quoted(GIVEN)}, {quoted(TAKEN)}, 'g') as t
  from documents
), cut as (
  select doc_id, body, string_split(regexp_replace(t, '([.!?;]) ', '\\1' || chr(10), 'g'), chr(10)) as sentences
  from plain
), known as (
  select doc_id, flatten(list_transform(list_transform(sentences, lambda s: list_filter([{named}], lambda x: x is not null)),
    lambda f: list_filter(f, lambda x: x <> 'some-licence' or not list_has_any(f, [{", ".join(quoted(i) for i in NAMING)}])))) as ids,
    list_transform(regexp_extract_all(body, {quoted(SPDX)}, 1), lambda x: 'SPDX:' || x) as spdx
  from cut
), r0 as (
  select doc_id, ids, spdx, array_to_string(list_transform(ids, lambda x: ',' || x || ','), '') as l, []::varchar[] as found from known
), {", ".join(steps)}
select doc_id, len(ids)::bigint as n_sentences, array_to_string(ids, ',') as sentence_ids,
  array_to_string(list_concat(found, list_distinct(spdx)), ',') as licences,
  len(list_filter(string_split(l, ','), lambda x: x <> ''))::bigint as n_left
from r{len(RULES)}
"""


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences, n_left) for every row; lists are joined by commas."""
    body = text_or_empty(text)
    spdx = F.regexp_extract_all(F.lower(body), F.lit(SPDX), F.lit(1))
    out = df.select(F.col(key).alias("doc_id"), sentence_ids(body).alias("ids"), F.transform(spdx, lambda x: F.concat(F.lit("SPDX:"), x)).alias("spdx"))
    out = out.select("doc_id", "ids", "spdx", F.array_join(F.transform("ids", lambda x: F.concat(F.lit(","), x, F.lit(","))), "").alias("sequence"))
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(rule_pattern(ids)).alias("pattern"), F.lit(rule_rest(ids)).alias("rest")) for n, ids in RULES])
    fits = lambda a, r: F.call_function("rlike", a["left"], r["pattern"])
    step = lambda a, r: F.struct(
        F.when(fits(a, r), F.regexp_replace(a["left"], r["pattern"], r["rest"])).otherwise(a["left"]).alias("left"),
        F.when(fits(a, r) & ~F.array_contains(a["found"], r["name"]), F.array_append(a["found"], r["name"])).otherwise(a["found"]).alias("found"),
    )
    start = F.struct(F.col("sequence").alias("left"), F.array().cast("array<string>").alias("found"))
    out = out.withColumn("end", F.when(F.size("ids") > 0, F.aggregate(rules, start, step)).otherwise(start))
    left = F.filter(F.split("end.left", ","), lambda x: x != "")
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.array_join(F.array_distinct(F.concat("end.found", "spdx")), ",").alias("licences"), F.size(left).cast("long").alias("n_left")
    )

"""Licence scans by canonical digest: entire texts, their paragraphs and their lines are hash-joined to known licences.

The canonical form is lower-case, without copyright lines (behind comment marks too) and punctuation, with one spelling
for words that have several, and single blanks. A unit matches if the digest of its whole canonical form is that of a
known one. A known text of several paragraphs is found where all of them are units of the text, in any order, unless
another known text that has all of them and more is found as well.

Defined cases: a null or empty text, or one of copyright lines and punctuation only, has an empty canonical form, which
matches nothing; a licence found twice is named once; repeated rows are scanned one by one; an empty table has an empty
result; an empty list of licences matches nothing; extra columns are ignored.

`sql()` knows LICENSES only, no complete texts of several paragraphs, and drops lines that begin with `copyright` whatever
follows; it says the same as `scan` where documents have neither, nor copyright lines behind comment marks.
"""

from __future__ import annotations

import functools
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."

#: (id, kind, text) of known licences and of the notices that refer to them.
LICENSES = (
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("Apache-2.0", "permissive", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "permissive", "Released under the MIT License."),
    ("MIT", "permissive", "Licensed under the MIT License."),
    ("MIT", "permissive", "SPDX-License-Identifier: MIT"),
    ("MIT", "permissive", f"{_GRANT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT-0", "permissive", f"{_GRANT}. {_AS_IS}"),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "copyleft", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "attribution", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "public", "Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "public", "This is free and unencumbered software released into the public domain."),
)

_BSD = ("All rights reserved.",)
#: (id, kind, titles, what may stand below the title) of complete texts in license_texts, which hold no title themselves.
SHORT_TEXTS = (
    ("BSD-3-Clause", "permissive", ("BSD 3-Clause License", "The 3-Clause BSD License", "BSD 3-Clause \"New\" or \"Revised\" License", "The BSD 3-Clause License", "The BSD License"), _BSD),
    ("BSD-2-Clause", "permissive", ("BSD 2-Clause License", "The 2-Clause BSD License", "BSD 2-Clause \"Simplified\" License", "The BSD 2-Clause License"), _BSD),
    ("ISC", "permissive", ("ISC License", "The ISC License", "ISC License (ISC)"), ()),
    ("0BSD", "permissive", ("BSD Zero Clause License", "Zero-Clause BSD", "0BSD"), ()),
    ("Unlicense", "public", ("The Unlicense", "Unlicense"), ()),
)
#: (id, kind) of complete texts in license_texts that begin with a paragraph of title and may end before an appendix.
LONG_TEXTS = (("Apache-2.0", "permissive"), ("GPL-2.0", "copyleft"), ("GPL-3.0", "copyleft"), ("LGPL-2.1", "copyleft"), ("LGPL-3.0", "copyleft"), ("MPL-2.0", "copyleft"), ("CC0-1.0", "public"))
_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_END = "END OF TERMS AND CONDITIONS"


def full_texts() -> tuple[tuple[str, str, str], ...]:
    """(id, kind, text) of complete licence texts, with and without title, appendix and blank lines between list items."""
    where, out = Path(__file__).with_name("license_texts"), []

    def add(name: str, kind: str, body: str, titles: tuple[str, ...], below: tuple[str, ...] = ()) -> None:
        for title in ("", *titles):
            out.extend((name, kind, "\n\n".join(x for x in (title, line, body) if x)) for line in ("", *below))

    add("MIT", "permissive", f"{_GRANT}, subject to the following conditions:\n\n{_NOTICE}\n\n{_AS_IS}", ("MIT License", "The MIT License", "The MIT License (MIT)"))
    add("MIT-0", "permissive", f"{_GRANT}.\n\n{_AS_IS}", ("MIT No Attribution", "MIT No Attribution License"))
    for name, kind, titles, below in SHORT_TEXTS:
        body = (where / f"{name}.txt").read_text()
        for form in dict.fromkeys((body, re.sub(r"\n\n(?=[0-9]\. )", "\n", body))):
            for marked in dict.fromkeys((form, re.sub(r"(?m)^[0-9]\. ", "* ", form))):
                add(name, kind, marked, titles, below)
    for name, kind in LONG_TEXTS:
        text = (where / f"{name}.txt").read_text()
        for form in dict.fromkeys((text, text[: text.find(_END) + len(_END)] if _END in text else text)):
            out += [(name, kind, form), (name, kind, re.split(r"\n[ \t]*\n", form.strip(), maxsplit=1)[1])]
    return tuple(out)


#: Patterns of spellings and what stands for them all.
SPELLINGS = (
    (r"\blicen[cs]e(s|d|e|es)?\b", r"license\1"), (r"\blicencing\b", "licensing"), (r"\bsub license", "sublicense"), (r"\bnon commercial\b", "noncommercial"),
    (r"\bnon infringement\b", "noninfringement"), (r"\bmerchantibility\b", "merchantability"), (r"\borganis", "organiz"), (r"\bauthoris", "authoriz"), (r"\bfavour", "favor"), (r"\bwhilst\b", "while"),
    (r"\bper cent\b", "percent"), (r"\bcopyright (owner|holder)", r"copyright holder"), (r"\bhttps?\b", "http"), (r"\bv(er|ersion)? ?([0-9])", r"version \2"),
)
_COPYRIGHT = r"(^|\n)[ \t]*(copyright( ?\(c\))? [^\n]*|\(c\)[^\n]*|©[^\n]*)"
#: A copyright line, with what may mark it as a comment; a line of prose or of a licence that begins with the word is none, nor is a clause (c).
_COPYRIGHT_LINE = r"(^|\n)[\p{P}\p{S} \t]*((rem|dnl)[ \t]+)?(copyright(?![ \t]+(notices?|owners?|holders?|licen[cs]es?|laws?|statements?|interests?|protection|and|or|in|is|to|of|for)\b)( ?\(c\))? [^\n]*|\(c\)(?![ \t]+(you|the|any|all|an?|if|each|such)\b)[^\n]*|©[^\n]*)"
_PUNCTUATION = r"[\p{P}\p{S}]+"
_BLANKS = r"[ \t\r\f\x0B]+"


#: What a text must hold for a rule to have anything to change; finding a word is far cheaper than matching a pattern.
_COPYRIGHT_HINTS = ("copyright", "(c)", "©")
_SPELLING_HINTS = (("licen",), ("licencing",), ("sub license",), ("non commercial",), ("non infringement",), ("merchantibility",), ("organis",), ("authoris",), ("favour",), ("whilst",), ("per cent",), ("copyright ",), ("http",), ())
#: Marks and blanks of ASCII but a single blank, which stays; and any character that may be a mark beyond ASCII.
_ASCII_GAPS = r"[!-/:-@\[-`{-~\t\r\f\x0B][!-/:-@\[-`{-~ \t\r\f\x0B]*| [!-/:-@\[-`{-~ \t\r\f\x0B]+"
_GAPS = r"[\p{P}\p{S}\t\r\f\x0B][\p{P}\p{S} \t\r\f\x0B]*| [\p{P}\p{S} \t\r\f\x0B]+"
_BEYOND = r"[^\x00-\x7F\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]"


def _let(value: Column, then) -> Column:
    """then(value), with value written out once, however often `then` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def canonical_lines(text: Column) -> Column:
    """The canonical form with its line breaks."""

    def rule(now: Column, when, then) -> Column:
        return _let(now, lambda x: F.when(when(x), then(x)).otherwise(x))

    holds = lambda hints: lambda x: functools.reduce(Column.__or__, [F.contains(x, F.lit(h)) for h in hints])
    now = rule(F.lower(F.coalesce(text, F.lit(""))), holds(_COPYRIGHT_HINTS), lambda x: F.regexp_replace(x, _COPYRIGHT_LINE, "\n"))
    now = _let(now, lambda x: F.when(x.rlike(_BEYOND), F.regexp_replace(x, _GAPS, " ")).otherwise(F.regexp_replace(x, _ASCII_GAPS, " ")))
    for (pattern, to), hints in zip(SPELLINGS, _SPELLING_HINTS):
        now = rule(now, holds(hints) if hints else lambda x: x.rlike("[0-9]"), lambda x, p=pattern, t=to: F.regexp_replace(x, p, t.replace("\\", "$")))
    return F.regexp_replace(now, r" ?\n ?", "\n")


def _flat(unit: Column) -> Column:
    """A unit of the canonical form in one line; it has single blanks already, and none beside a line break."""
    return F.trim(F.regexp_replace(unit, r"\n+", " "))


def _digest(unit: Column) -> Column:
    return F.sha2(_flat(unit), 256)


def _forms(spark: SparkSession, licenses) -> DataFrame:
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(licenses)], "i int, license string, kind string, text string")
    return rows.withColumn("_c", canonical_lines(F.col("text")))


def known_digests(spark: SparkSession, licenses=LICENSES) -> DataFrame:
    """(digest, license, kind, length) of each distinct canonical text; the first of equal ones counts."""
    one = _forms(spark, licenses).select("i", "license", "kind", _digest(F.col("_c")).alias("digest"), F.length(_flat(F.col("_c"))).alias("length"))
    return one.where("length > 0").groupBy("digest").agg(F.min_by(F.struct("license", "kind", "length"), "i").alias("x")).select("digest", "x.*")


def known_parts(spark: SparkSession, licenses) -> list:
    """(license, kind, parts, hashes) of each distinct set of paragraphs, the first of equal ones: the paragraphs' digests and short hashes."""
    units = F.filter(F.transform(F.split("_c", r"\n\n+"), _flat), lambda u: u != "")
    form = _forms(spark, licenses).select("i", "license", "kind", F.array_distinct(units).alias("u")).where(F.size("u") > 0)
    first = {}
    for r in sorted(form.select("i", "license", "kind", F.transform("u", lambda u: F.sha2(u, 256)).alias("parts"), F.transform("u", lambda u: F.xxhash64(u)).alias("hashes")).collect()):  # a fixed list, not the corpus
        first.setdefault(frozenset(r.parts), r)
    return list(first.values())


def scan(docs: DataFrame, licenses=None) -> DataFrame:
    """(doc_id, digest, text_license, licenses, kinds, n_notices): the licence the entire text is, and those its paragraphs and lines hold.

    licenses: (id, kind, text); LICENSES and full_texts() by default. Texts are read once and only digests are joined.
    """
    spark = docs.sparkSession
    licenses = (*LICENSES, *full_texts()) if licenses is None else licenses
    groups = known_parts(spark, licenses)
    sets = [frozenset(r.parts) for r in groups]
    numbers = {d: k for k, d in enumerate(sorted(set().union(*sets)))}
    # for each known text: its name and kind, its paragraphs, and the known texts that have more
    told = F.array(*(
        F.struct(F.lit(g).alias("g"), F.lit(r.license).alias("license"), F.lit(r.kind).alias("kind"), F.lit(sorted(numbers[d] for d in s)).alias("parts"), F.lit([h for h, x in enumerate(sets) if x > s]).cast("array<int>").alias("more"))
        for g, (r, s) in enumerate(zip(groups, sets))
    ))
    hashes = sorted({h for r in groups for h in r.hashes})
    # only a unit that has some known paragraph's short hash needs a digest
    asked = lambda units: F.filter(units, lambda u: F.xxhash64(u).isin(hashes) if hashes else F.lit(False))
    units = lambda c: F.concat(asked(F.transform(F.split(c, r"\n"), lambda u: F.trim(u))), asked(F.transform(F.split(c, r"\n\n+"), _flat)))
    place = F.create_map(*(F.lit(x) for pair in (numbers or {"": -1}).items() for x in pair))
    parts = lambda c: F.array_distinct(F.filter(F.transform(units(c), lambda u: F.element_at(place, F.sha2(u, 256))), F.isnotnull))
    held = lambda c: _let(parts(c), lambda p: F.when(F.size(p) > 0, F.filter(told, lambda t: F.size(F.array_except(t.parts, p)) == 0)))
    widest = lambda c: _let(held(c), lambda all_: F.filter(all_, lambda t: ~F.arrays_overlap(t.more, F.transform(all_, lambda x: x.g))))
    names = lambda field, found: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda t: t[field]))), ","), F.lit(""))
    said = lambda found: F.struct(names("license", found).alias("licenses"), names("kind", found).alias("kinds"), F.greatest(F.size(found), F.lit(0)).cast("long").alias("n_notices"))
    none = F.lit(None).cast("array<struct<license:string,kind:string>>")
    judged = docs.select("doc_id", _let(canonical_lines(F.col("text")), lambda c: F.struct(_digest(c).alias("digest"), (_let(widest(c), said) if groups else said(none)).alias("said"))).alias("_x"))
    known = known_digests(spark, licenses).select(F.col("digest").alias("_digest"), F.col("license").alias("text_license"))
    # one row for each known licence text
    return judged.join(F.broadcast(known), F.col("_x.digest") == F.col("_digest"), "left").select("doc_id", "_x.digest", "text_license", "_x.said.licenses", "_x.said.kinds", "_x.said.n_notices")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql() -> str:
    def form(x: str) -> str:
        out = f"regexp_replace(lower(coalesce({x}, '')), '{_COPYRIGHT}', chr(10), 'g')"
        out = f"regexp_replace(regexp_replace({out}, '{_PUNCTUATION}', ' ', 'g'), '{_BLANKS}', ' ', 'g')"
        for pattern, to in SPELLINGS:
            out = f"regexp_replace({out}, '{pattern}', '{to}', 'g')"
        return f"regexp_replace({out}, ' ?\\n ?', chr(10), 'g')"

    flat = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    values = ", ".join("(%d, '%s', '%s', '%s')" % (i, *(v.replace("'", "''") for v in x)) for i, x in enumerate(LICENSES))
    return f"""
WITH v(i, license, kind, text) AS (VALUES {values}),
k0 AS (SELECT i, license, kind, {flat('c')} AS t FROM (SELECT *, {form('text')} AS c FROM v)),
k AS (SELECT sha256(t) AS digest, arg_min(license, i) AS license, arg_min(kind, i) AS kind FROM k0 WHERE length(t) > 0 GROUP BY t),
d AS (SELECT row_number() OVER () AS rid, doc_id, {form('text')} AS c FROM documents),
w AS (SELECT rid, doc_id, c, sha256({flat('c')}) AS digest FROM d),
u AS (SELECT rid, unnest(list_concat(string_split(c, chr(10)), string_split_regex(c, '\\n\\n+'))) AS x FROM w),
h AS (SELECT DISTINCT rid, sha256({flat('x')}) AS g FROM u),
n AS (SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, count(*) AS n_notices FROM h JOIN k ON h.g = k.digest GROUP BY rid)
SELECT doc_id, w.digest AS digest, k.license AS text_license, coalesce(licenses, '') AS licenses, coalesce(kinds, '') AS kinds, coalesce(n_notices, 0) AS n_notices
FROM w LEFT JOIN n USING (rid) LEFT JOIN k ON w.digest = k.digest"""

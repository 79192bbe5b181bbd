"""Licence scan by canonical digests.

A text's canonical form is lower-case, without copyright lines, with one spelling for words that are
written in several ways, and with every run of characters other than letters and digits as one blank.
Whole texts are hash-joined by the SHA-256 of that form to the digests of known licence texts; the same
digest of each single line finds one-line notices ("Licensed under ...").  All tables of known
digests are fixed lists in ``licence_texts``, so they are broadcast.

Short licences are also known by their bare form, which loses what files add to them: marks of comments, lines
that only name the licence or announce its notice, and marks of lists, whichever are used.

Main path: DataFrame expressions only, one pass and no shuffle.

Defined results: null and empty texts have the digest of the empty text and no licence; every row is
returned, repeated rows alike; extra columns pass through ``scanned`` unless named like its results; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import LONG_TEXTS, NOTICES, TEXTS

#: Words after "copyright" that go on with a sentence of the licence, wrapped there, and are no holder's name.
PROSE = "holder|owner|notice|law|licen[sc]e|statement|treat|interest|claim|protect|permission|right|disclaimer|and|or|in|is|are|of|to|on|that|as|for|under|can|may|does|do|has"
#: Marks of comments and of quotes before a line.
COMMENT = r"[ \t*#/;>%!|-]*(?:(?:dnl|rem)[ \t]+)?"
#: A notice: copyright with a sign, a year or a name behind it, a sign with a year, or the usual second line.
COPYRIGHT_LINE = (
    rf"(^|\n){COMMENT}(copyright[ \t]*(:|©|\(c\)|[ \t](?!({PROSE})(d|s|y|ies|ed|able)?\b)[^\s])|\(c\)[ \t]*(copyright\b|[0-9]{{4}})|©|all rights reserved)[^\n]*"
)
#: Lines, without marks, that only name a licence or announce its notice.
HEADING = (
    r"^((the )?(mit|mit no attribution|isc|zlib|zlib/libpng|0bsd|bsd|new bsd|revised bsd|modified bsd|simplified bsd|freebsd|(the )?bsd[ -][023][ -]clause|[023][ -]clause bsd)"
    r"( [\"'(]*(new|revised|modified|simplified|freebsd|original)[\"')]*)?( licen[sc]e)?( [(](mit|expat|mit-0|isc|0bsd|zlib|bsd-[23]-clause)[)])?|(the )?(copyright|licen[sc]e)( notice| information| text)?s?)[ \t]*[:.]?$"
)
#: Marks of lists at the start of a line, and in text after a sign.
ITEM, INNER_ITEM = r"^[(]?([0-9]{1,2}|[a-z]|[ivx]{1,4})[.)][ \t]+", r"([:.;,])[ \t]+[(]?[0-9]{1,2}[.)][ \t]+"
#: Every short licence has this word.
SHORT_MARK = "software"
NOT_ALNUM = r"[^\p{L}\p{N}]+"
#: Equivalent spellings, between blanks.
SPELLINGS = (
    (r" licence", " license"), (r" sub license", " sublicense"), (r" merchantibility ", " merchantability "),
    (r" acknowledgement", " acknowledgment"), (r" non infringement ", " noninfringement "), (r" https? ", " http "),
    (r" (copyright owner|copyright holder)s? ", " copyright holder "), (r" per cent ", " percent "),
)
#: Every known notice has this word, which the canonical form keeps; texts and lines without it are not looked at.
MARK = r"(^|[^\p{L}\p{N}])under($|[^\p{L}\p{N}])"


def bare(text: Column) -> Column:
    """The canonical form of what a file holds besides comment marks, headings and list marks."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    lines = F.transform(F.split(t, "\n"), lambda x: F.btrim(F.regexp_replace(x, f"^{COMMENT}", ""), F.lit(" \t\r*/")))
    lines = F.transform(F.filter(lines, lambda x: ~x.rlike(HEADING)), lambda x: F.regexp_replace(x, ITEM, ""))
    return _spelled(F.regexp_replace(F.array_join(lines, " "), INNER_ITEM, "$1 "))


def bare_text(text: str) -> str:
    """The same in Python, for the known texts."""
    t = re.sub(COPYRIGHT_LINE, r"\1", text.lower())
    lines = [re.sub(f"^{COMMENT}", "", x).strip(" \t\r*/") for x in t.split("\n")]
    lines = [re.sub(ITEM, "", x) for x in lines if not re.search(HEADING, x)]
    return canonical_text(re.sub(INNER_ITEM, r"\1 ", " ".join(lines)))


def canonical(text: Column) -> Column:
    return _spelled(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1"))


def _spelled(t: Column) -> Column:
    t = F.concat(F.lit(" "), F.regexp_replace(t, NOT_ALNUM, " "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.regexp_replace(t, a, b)
    return F.btrim(t)


def canonical_text(text: str) -> str:
    """The same in Python, for the known texts."""
    t = re.sub(COPYRIGHT_LINE, r"\1", text.lower())
    t = " " + re.sub(r"[\W_]+", " ", t) + " "
    for a, b in SPELLINGS:
        t = re.sub(a, b, t)
    return t.strip(" ")


def _digests(known, form=canonical_text) -> list[tuple[str, str]]:
    return sorted({(hashlib.sha256(form(t).encode()).hexdigest(), spdx) for spdx, t in known})


#: A column of our own while two look-ups are put together.
LONG = "_licence by digest"


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus digest, licence (of the whole text, or null) and notices (array of SPDX ids, sorted)."""
    spark = docs.sparkSession
    assert all("under" in canonical_text(t).split(" ") for _, t in NOTICES)
    known = spark.createDataFrame(sorted({*_digests(TEXTS), *LONG_TEXTS}), "digest string, licence string")
    names = _digests(NOTICES)
    by_digest = F.create_map(*(F.lit(x) for pair in names for x in pair))
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.lower(x).rlike(MARK))
    found = F.transform(lines, lambda x: F.element_at(by_digest, F.sha2(canonical(x), 256)))
    notices = F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))
    assert all(SHORT_MARK in t.lower() for _, t in TEXTS)
    by_bare = F.create_map(*(F.lit(x) for pair in _digests(TEXTS, bare_text) for x in pair))
    d = docs.withColumns(
        {
            "digest": F.sha2(canonical(F.col(text)), 256),
            "licence": F.when(F.lower(t).contains(SHORT_MARK), F.element_at(by_bare, F.sha2(bare(t), 256))),
            "notices": F.when(F.lower(t).rlike(MARK), notices).otherwise(F.array().cast("array<string>")),
        }
    )
    d = d.join(F.broadcast(known.withColumnRenamed("licence", LONG)), "digest", "left")
    return d.withColumn("licence", F.coalesce(LONG, "licence")).drop(LONG)


def op6(docs: DataFrame) -> DataFrame:
    return scanned(docs.select("doc_id", "text")).select(
        "doc_id", "digest", "licence", F.array_join("notices", ",").alias("notices"), F.size("notices").cast("long").alias("n_notices")
    )


def _uncopyrighted_sql(x: str) -> str:
    """Lower-case text without copyright lines, for an engine without look-ahead: words after "copyright" that go on with a sentence are marked, and the mark goes again."""
    prose = rf"(^|\n)({COMMENT})copyright([ \t]+({PROSE})(d|s|y|ies|ed|able)?\b)"
    line = COPYRIGHT_LINE.replace(rf"(?!({PROSE})(d|s|y|ies|ed|able)?\b)", "")
    assert "(?!" not in line
    t = f"regexp_replace(lower(coalesce({x}, '')), '{prose}', '\\1\\2copyright\ue000\\3', 'g')"
    return f"replace(regexp_replace({t}, '{line}', '\\1', 'g'), 'copyright\ue000', 'copyright')"


def _canonical_sql(x: str) -> str:
    return _spelled_sql(_uncopyrighted_sql(x))


def _bare_sql(x: str) -> str:
    lines = f"list_transform(string_split({_uncopyrighted_sql(x)}, chr(10)), lambda x: trim(regexp_replace(x, '^{COMMENT}', ''), ' ' || chr(9) || chr(13) || '*/'))"
    heading = HEADING.replace("'", "''")
    lines = f"list_transform(list_filter({lines}, lambda x: NOT regexp_matches(x, '{heading}')), lambda x: regexp_replace(x, '{ITEM}', ''))"
    return _spelled_sql(f"regexp_replace(array_to_string({lines}, ' '), '{INNER_ITEM}', '\\1 ', 'g')")


def _spelled_sql(t: str) -> str:
    t = f"(' ' || regexp_replace({t}, '{NOT_ALNUM}', ' ', 'g') || ' ')"
    for a, b in SPELLINGS:
        t = f"regexp_replace({t}, '{a}', '{b}', 'g')"
    return f"trim({t}, ' ')"


def oracle() -> str:
    values = lambda known: ", ".join(f"('{d}', '{s}')" for d, s in known)
    return f"""
WITH short(digest, licence) AS (VALUES {values(_digests(TEXTS, bare_text))}),
known(digest, licence) AS (VALUES {values(sorted({*_digests(TEXTS), *LONG_TEXTS}))}),
notice(digest, licence) AS (VALUES {values(_digests(NOTICES))}),
d AS (SELECT row_number() OVER () AS rid, doc_id, text, sha256({_canonical_sql('text')}) AS digest,
  CASE WHEN contains(lower(text), '{SHORT_MARK}') THEN sha256({_bare_sql('text')}) END AS bare FROM documents),
l AS (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
n AS (SELECT rid, list_sort(list(DISTINCT notice.licence)) AS notices
      FROM l JOIN notice ON notice.digest = sha256({_canonical_sql('line')}) WHERE regexp_matches(lower(line), '{MARK}') GROUP BY rid)
SELECT doc_id, d.digest, coalesce(known.licence, short.licence) AS licence, coalesce(array_to_string(notices, ','), '') AS notices, coalesce(len(notices), 0)::BIGINT AS n_notices
FROM d LEFT JOIN known ON known.digest = d.digest LEFT JOIN short ON short.digest = d.bare LEFT JOIN n USING (rid)
"""

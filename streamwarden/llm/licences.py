"""Licence scan by canonical digests, in DataFrame functions only.

A text is lower-cased, loses its copyright notices, takes the usual one of equal
spellings and has everything but letters and digits turned into single spaces; its
SHA-256 is looked up among the digests of known licence texts by a hash join. A line
is a notice if it starts with copyright, (c) or the sign and then a year, with
copyright and (c), or with the sign; if it holds nothing but "all rights reserved";
or if it starts with copyright or "all rights reserved" and stands, with up to seven
more such lines of at most 120 characters, between blank lines. Other lines that
start so belong to a sentence and stay, so that a licence's digest does not depend
on where it is wrapped. A line with over 300 characters after its year or sign is
more than a notice and stays whole. The notices inside the known texts (the Free
Software Foundation's, and forms to be filled in) end at known words and go wherever
they stand. The
same is done for the lines of a text that can be a notice (all known notices have
the word ``licen``, so other lines need no digest). The known side is the fixed list
of ``licence_texts.py``, a few rows.

One pass over the texts; only a row per text and one per line that is a notice are
shuffled, combined before.

Cases: a null text is empty and has no licence. Rows are handled one by one, so null
or repeated ids and repeated rows stay as they are; a text that consists of
copyright lines only is like an empty one. An empty table gives an empty result;
other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamwarden.llm.columns import documents, text_of
from streamwarden.llm.licence_texts import EQUAL_SPELLINGS, LONG_TEXTS, NOTICES, SHORTENED, TEXTS, TITLES

# Within what both Java's and RE2's expressions allow; repeats of groups are bounded.
_GAP = r"[^\p{L}\p{N}\n]"
_YEAR = r"(?:(?:19|20)[0-9]{2}|[<\[{](?:year|yyyy))"
_UNQUOTED = r"[^\p{L}\p{N}\n\x22\x27“”‘’]"  # a quoted word is being defined
# one to eight short lines between blank lines or the text's ends
_PARAGRAPH = (
    rf"(?:\A|^{_GAP}*\n){_UNQUOTED}*(?:copyright\b|©|all rights reserved\b)[^\n]{{0,120}}"
    rf"(?:\n{_UNQUOTED}*(?:copyright\b|©|\(c\)|all rights reserved\b)[^\n]{{0,120}}){{0,7}}(?:\n{_GAP}*$|\z)"
)
_LINE = (
    rf"^{_GAP}*(?:(?:copyright|\(c\)|©)(?:{_GAP}|\(c\)|copyright){{0,40}}{_YEAR}[^\n]{{0,300}}"
    rf"|(?:copyright{_GAP}{{0,40}}\(c\)|copyright{_GAP}{{0,40}}©|©)[^\n]{{0,300}}|all rights reserved{_GAP}*)$"
)
# notices that are part of known texts; their ends are known, so they go wherever they stand
_BREAK = r"[^\p{L}\p{N}]+"
_PUBLISHER = rf"(?:{_BREAK}(?:19|20)[0-9]{{2}}){{1,9}}{_BREAK}" + _BREAK.join(["free", "software", "foundation", "inc"])
_ADDRESS = "|".join(
    _BREAK.join(words.split())
    for words in (
        "https? fsf org",
        "51 franklin st(?:reet)? fifth floor boston ma 02110 1301 usa",
        "59 temple place suite 330 boston ma 02111 1307 usa",
    )
)
_HOLDER = rf"(?:name{_BREAK}of{_BREAK}(?:copyright{_BREAK}(?:owner|holder)|author)|your{_BREAK}name)"
_BLANK_FORM = rf"{_BREAK}(?:(?:yyyy|year|19yy|19xx){_BREAK}{_HOLDER}|all{_BREAK}rights{_BREAK}reserved)"
_KNOWN = (
    rf"(?:^{_GAP}*(?:\n{_GAP}*)?)?\bcopyright(?:{_BREAK}c)?"
    rf"(?:{_PUBLISHER}(?:{_BREAK}(?:{_ADDRESS}))?|{_BLANK_FORM})\b"
)
COPYRIGHT_LINE = f"(?m){_KNOWN}|{_PARAGRAPH}|{_LINE}"
NOT_WORD = r"[^\p{L}\p{N}]+"
MARK = "licen"


def canonical(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, "")
    plain = F.trim(F.regexp_replace(plain, NOT_WORD, " "))
    for other, usual in EQUAL_SPELLINGS:
        plain = F.replace(plain, F.lit(other), F.lit(usual))
    return plain


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def _known_texts() -> list[tuple[str, bool, str]]:
    """(licence, is a whole text, text)."""
    known = [(name, False, text) for name, text in NOTICES.items()]
    known += [(name, True, text) for name, text in [*NOTICES.items(), *TEXTS.items(), *LONG_TEXTS, *SHORTENED]]
    known += [(name, True, f"{title}\n\n{TEXTS[name]}") for name, title in TITLES.items()]
    return known


def known_digests(spark) -> DataFrame:
    """(known_digest, whole, licence) of the fixed list."""
    rows = [
        F.struct(F.lit(name).alias("licence"), F.lit(whole).alias("whole"), F.lit(text).alias("text"))
        for name, whole, text in _known_texts()
    ]
    texts = spark.range(1).select(F.inline(F.array(*rows)))
    return texts.select(digest(F.col("text")).alias("known_digest"), "whole", "licence")


def scan(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: digest of its canonical text, the licence that text is, and the
    licences of its notice lines."""
    text = text_of(text_column)
    lines = F.filter(F.split(text, "\n"), lambda line: F.lower(line).contains(MARK))
    units = F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), text.alias("unit"))),
        F.transform(lines, lambda line: F.struct(F.lit(False).alias("whole"), line.alias("unit"))),
    )
    # the number holds within this one pass only
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("doc_id"), units.alias("units"))
    each = numbered.select("row", "doc_id", F.explode("units").alias("at")).select(
        "row", "doc_id", "at.whole", digest(F.col("at.unit")).alias("digest")
    )
    known = F.broadcast(known_digests(docs.sparkSession))  # a few fixed rows
    named = each.join(known, (each["digest"] == known["known_digest"]) & (each["whole"] == known["whole"]), "left").select(
        "row", "doc_id", each["whole"], "digest", "licence"
    )
    named = named.filter("whole OR licence IS NOT NULL")
    line_licence = F.when(~F.col("whole"), F.col("licence"))
    return (
        named.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max(F.when(F.col("whole"), F.col("digest"))).alias("text_digest"),
            F.max(F.when(F.col("whole"), F.col("licence"))).alias("text_licence"),
            F.count(line_licence).alias("n_notices"),
            F.array_join(F.array_sort(F.collect_set(line_licence)), ",").alias("notices"),
        )
        .drop("row")
    )


def op7_licence_digests(spark, folder: str) -> DataFrame:
    return scan(documents(spark, folder))


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    plain = f"regexp_replace(lower({text}), '{COPYRIGHT_LINE}', '', 'g')"
    plain = f"trim(regexp_replace({plain}, '{NOT_WORD}', ' ', 'g'))"
    for other, usual in EQUAL_SPELLINGS:
        plain = f"replace({plain}, '{other}', '{usual}')"
    return plain


ORACLE = f"""
WITH known AS (
  SELECT licence, whole, sha256({_sql_canonical("text")}) AS digest
  FROM (VALUES {", ".join(f"('{n}', {str(w).lower()}, {_sql_text(t)})" for n, w, t in _known_texts())}) AS k(licence, whole, text)
), texts AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT row, sha256({_sql_canonical("line")}) AS digest
  FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM texts)
), notices AS (
  SELECT row, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM lines JOIN known ON lines.digest = known.digest AND NOT known.whole GROUP BY row
), digests AS (
  SELECT row, doc_id, sha256({_sql_canonical("text")}) AS text_digest FROM texts
)
SELECT doc_id, text_digest, known.licence AS text_licence, coalesce(n_notices, 0) AS n_notices, coalesce(notices, '') AS notices
FROM digests LEFT JOIN known ON digests.text_digest = known.digest AND known.whole LEFT JOIN notices USING (row)
"""

"""Queries of the corpus operators over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import bpe, decontam, fingerprint, langid, licenses, lm, minhash, quality, secrets, toxicity
from quillmark.llm.common import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"))


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_digests(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known(spark))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_secrets": op1_secrets, "op2_bpe": op2_bpe, "op3_lm": op3_lm, "op4_quality": op4_quality, "op5_fingerprint": op5_fingerprint, "op6_licenses": op6_licenses, "op7_minhash": op7_minhash, "op8_langid": op8_langid, "op9_decontam": op9_decontam, "op10_toxicity": op10_toxicity}


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern, replacement in licenses.STEPS:
        out = f"regexp_replace({out}, {_literal(pattern)}, {_literal(replacement.replace('$', chr(92)))}, 'g')"
    return f"trim({out})"


_WORDED = " OR ".join(f"contains(lower({{}}), '{w}')" for w in licenses.WORDS)
_FULL = ", ".join(f"('{i}', '{d}', {n}, '{h}', {c})" for i, d, n, h, c in licenses.FULL)
#: Lines and paragraphs of several lines against the forms of notices; every place of a text's form where a full text begins, against its digest.
LICENSES_SQL = rf"""
WITH notices AS (SELECT {_canonical_sql('t')} AS form, min(id) AS license_id FROM (VALUES {', '.join(f"({_literal(i)}, {_literal(t)})" for i, t in licenses.NOTICES)}) k(id, t) GROUP BY 1),
fulls AS (SELECT * FROM (VALUES {_FULL}) f(license_id, digest, size, head, core)),
docs AS (SELECT doc_id, text, {_canonical_sql('text')} AS form FROM documents WHERE {_WORDED.format(*['text'] * len(licenses.WORDS))}),
parts AS (SELECT doc_id, form AS every, unnest(list_concat(string_split(text, chr(10)), list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda p: regexp_matches(p, '\S\s*\n\s*\S')))) AS part FROM docs),
units AS (SELECT doc_id, every, {_canonical_sql('part')} AS form FROM parts),
found AS (SELECT doc_id, license_id, 1 AS n, every = form AS whole FROM units JOIN notices USING (form)),
places AS (SELECT doc_id, form, head, unnest(range(1, length(form) - 30)) AS pos FROM docs JOIN (SELECT DISTINCT head FROM fulls) h ON contains(form, head)),
met AS (SELECT doc_id, license_id, CASE WHEN core THEN 1 ELSE 0 END AS n, length(form) = size AS whole FROM places p JOIN fulls f ON p.head = f.head AND substr(form, pos, 32) = f.head
  WHERE (pos = 1 OR substr(form, pos - 1, 1) = ' ') AND sha256(substr(form, pos, size)) = digest)
SELECT doc_id, license_id, CAST(sum(n) AS BIGINT) AS n_parts, bool_or(whole) AS whole FROM (SELECT * FROM found UNION ALL SELECT * FROM met) a GROUP BY 1, 2"""

#: Lower-cased words, their shingles of four, pairs that share any, and the least id that links reach.
NEAR_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(2, len(w) - 2)), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
classes AS (SELECT list_sort(s) AS s, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY 1),
shingles AS (SELECT rep, len(s) AS n, unnest(s) AS g FROM classes),
links AS (SELECT a.rep AS a, b.rep AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT rep AS id, rep AS seen FROM classes UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.seen = e.a),
lowest AS (SELECT id AS rep, min(seen) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN classes ON list_sort(sets.s) = classes.s LEFT JOIN lowest USING (rep)"""


_WORDS_SQL = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
#: Every token of every document against every token of every item: pairs of equal ones by the offset between them, and the best run of places at each offset.
OVERLAPS_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents),
items AS (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, {_WORDS_SQL} AS w FROM benchmark) b WHERE len(w) > 0),
own AS (SELECT r, len(w) AS n, unnest(w) AS t, unnest(range(len(w))) AS p FROM docs),
other AS (SELECT i, item_id, len(w) AS n, least(12, len(w)) AS size, unnest(w) AS t, unnest(range(len(w))) AS p FROM items),
met AS (SELECT r, i, any_value(item_id) AS item_id, any_value(size) AS size, o.p - x.p AS off, list(x.p) AS hits, greatest(0, -(o.p - x.p)) AS lo, least(any_value(x.n), any_value(o.n) - (o.p - x.p)) AS hi
  FROM own o JOIN other x USING (t) GROUP BY r, i, o.p - x.p HAVING count(*) >= ceil(any_value(size) * 80 / 100.0)),
best AS (SELECT r, item_id, size, off, list_max(list_transform(range(lo, hi - size + 1), lambda s: len(list_filter(hits, lambda p: p >= s AND p < s + size)))) AS agreeing FROM met WHERE hi - lo >= size),
told AS (SELECT doc_id, item_id, off, agreeing, size FROM best JOIN docs USING (r) WHERE agreeing >= ceil(size * 80 / 100.0))
SELECT doc_id, item_id, CAST(off AS INTEGER) AS start, CAST(agreeing AS INTEGER) AS agreeing, CAST(size AS INTEGER) AS places FROM told
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agreeing DESC, off) = 1"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express: licence look-up, exact near-duplicates, and overlaps of all windows."""
    return {"op6_licenses": LICENSES_SQL, "op7_minhash": NEAR_SQL, "op9_decontam": OVERLAPS_SQL}

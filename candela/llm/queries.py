"""The registered queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, balance, fingerprints, importance, jaccard, lines, mixing, neighbours, packing, pseudonyms, quality, secrets, substrings
from .runtime import prepare, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.report(table(spark, sf_dir, "documents"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(table(spark, sf_dir, "documents"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.pack_balanced(table(spark, sf_dir, "documents"))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _prepared(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {f.__name__: _prepared(f) for f in (
    op1_fingerprints, op2_pseudonyms, op3_secrets, op4_lines, op5_substrings, op6_jaccard, op7_packing, op8_fertility, op9_neighbours, op10_mixing,
    op11_alignment, op12_balanced, op13_importance)}

ORACLES: dict[str, str] = {
    "op4_lines": r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
keyed AS (SELECT doc_id, ls, list_transform(ls, lambda x: translate(trim(x, E' \t\n\x0B\x0C\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ks FROM docs),
often AS (SELECT k FROM (SELECT unnest(list_distinct(ks)) AS k FROM keyed) WHERE k <> '' GROUP BY k HAVING count(*) >= 10),
hot AS (SELECT coalesce(list(k), []) AS h FROM often),
cut AS (SELECT doc_id, len(ls) AS n, list_transform(list_filter(list_zip(ls, ks), lambda p: NOT list_contains(h, p[2])), lambda p: p[1]) AS kept FROM keyed, hot)
SELECT doc_id, n AS n_lines, n - len(kept) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM cut
""",
    "op5_substrings": r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
wins AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS w FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM docs)),
firsts AS (SELECT w, min(doc_id) AS f FROM wins GROUP BY w),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM wins JOIN firsts USING (w) WHERE f < doc_id),
all_words AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS p FROM docs),
kept AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM all_words a ANTI JOIN gone g ON a.doc_id = g.doc_id AND a.p = g.p GROUP BY a.doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs d LEFT JOIN kept USING (doc_id)
""",
    "op6_jaccard": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(generate_series(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS s FROM docs),
flat AS (SELECT doc_id, unnest(s) AS t FROM sets),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM flat a JOIN flat b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS r FROM edges UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.doc_id),
degree AS (SELECT a AS doc_id, count(*) AS n FROM edges GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles,
  CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE coalesce((SELECT min(doc_id) FROM sets z WHERE z.doc_id <= s.doc_id AND list_sort(z.s) = list_sort(s.s)), s.doc_id) END AS class_id,
  coalesce(d.n, 0) AS n_links, coalesce(c.r, s.doc_id) AS component_id
FROM sets s LEFT JOIN degree d USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) c USING (doc_id)
""",
    "op13_importance": r"""
WITH docs AS (SELECT 'd' AS side, doc_id, coalesce(text, '') AS t FROM documents UNION ALL SELECT 'b', NULL, coalesce(text, '') FROM benchmark),
worded AS (SELECT side, doc_id, regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM docs),
flat AS (SELECT side, doc_id, unnest(ws || list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) AS f FROM worded),
names AS (SELECT DISTINCT f, hex(encode(f)) AS x FROM flat),
-- CRC-32 bit by bit: each byte enters before eight shifts
crcs AS (SELECT f, xor(list_reduce(
    [4294967295::BIGINT] || flatten(list_transform(generate_series(1, len(x) - 1, 2), lambda i: [('0x' || x[i : i + 1])::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
    lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295) % 10000 AS b FROM names),
hashed AS (SELECT side, doc_id, b FROM flat JOIN crcs USING (f)),
counts AS (SELECT b, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM hashed GROUP BY b),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts),
gains AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS g FROM counts, sums),
weighed AS (SELECT doc_id, count(*) AS n, floor(sum(g)::DOUBLE / count(*))::BIGINT AS w FROM hashed JOIN gains USING (b) WHERE side = 'd' GROUP BY doc_id),
scored AS (SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight,
    coalesce(w, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM worded LEFT JOIN weighed USING (doc_id) WHERE side = 'd'),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM scored LEFT JOIN placed USING (doc_id)
""",
}

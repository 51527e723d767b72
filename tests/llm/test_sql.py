"""What SQL can express of operators whose whole results it can't: base figures, links and components, sequences."""

from __future__ import annotations

import pytest

from inkstrata.llm import queries

from ..compare import database, same

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
TEXTS = "SELECT doc_id, coalesce(text, '') AS text FROM documents"

QUALITY = rf"""
WITH docs AS ({TEXTS}), cut AS (SELECT doc_id, text, regexp_extract_all(text, '{WORD}') AS ws FROM docs),
windows AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM cut),
counted AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i : i + 7]) AS c FROM windows),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM counted WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM docs) WHERE regexp_matches(x, '{WORD}') GROUP BY doc_id),
base AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(lines.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM cut LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base"""

SECRETS = rf"""
SELECT doc_id, len(list_filter(regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12)) AS n_assign,
 len(list_filter(regexp_extract_all(text, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18)) AS n_access, len(list_filter(regexp_extract_all(text, '[0-9a-f]+'), lambda x: length(x) >= 16)) AS n_hex FROM ({TEXTS})"""

#: A card's digits from the last one: every second is doubled, 9 taken off where that has two digits.
PERSONAL = rf"""
WITH docs AS ({TEXTS}), digits AS (SELECT doc_id, text, list_transform(regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'), lambda x: reverse(regexp_replace(x, '[^0-9]', '', 'g'))) AS cards FROM docs)
SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email,
 len(list_filter(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: list_max(list_transform(string_split(x, '.'), lambda p: CAST(p AS HUGEINT))) <= 255)) AS n_ip,
 len(list_filter(cards, lambda x: length(x) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[i] AS INTEGER) ELSE 2 * CAST(x[i] AS INTEGER) - 9 * CAST(CAST(x[i] AS INTEGER) > 4 AS INTEGER) END)) % 10 = 0)) AS n_card,
 len(list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone FROM digits"""

#: From the fingerprints: a link at two bits or fewer, and the least id that can be reached.
COMPONENTS = """
WITH RECURSIVE prints AS MATERIALIZED (SELECT doc_id, fingerprint, CAST(('0x' || fingerprint) AS UBIGINT) AS fp FROM found),
links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM prints a JOIN prints b ON bit_count(xor(a.fp, b.fp)) <= 2),
reach(u, v) AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT p.doc_id, p.fingerprint, min(v) AS component_id FROM prints p JOIN reach ON u = p.doc_id GROUP BY ALL"""

#: Pieces and sequences that break a rule: none.
BROKEN = """
WITH placed AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY sequence_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM found),
cut AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY doc_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar, count(*) OVER (PARTITION BY doc_id) AS n FROM placed)
SELECT count(*) FILTER (WHERE before <> "offset" OR before + length > 1024) AS misplaced, count(*) FILTER (WHERE sofar <> start OR length > 1024 OR (piece > 0 AND length < 1024)) AS miscut,
 (SELECT count(DISTINCT doc_id) FROM found) = (SELECT count(*) FROM documents) AS every FROM cut"""


@pytest.mark.parametrize("name,sql", [("op4_weak_supervision", QUALITY), ("op8_zstd_secrets", SECRETS), ("op7_bootstrapped_pii", PERSONAL)])
def test_base_figures(spark, name, sql):
    con = database(SF)
    columns = [c[0] for c in con.execute(sql).description]
    same(queries.queries()[name](spark, SF).select(*columns), con, sql)


def test_components(spark):
    con, found = database(SF), queries.queries()["op5_simhash_near_dedup"](spark, SF).toPandas()
    con.register("found", found)
    same(spark.createDataFrame(found), con, COMPONENTS)


def test_sequences(spark):
    con = database(SF)
    con.register("found", queries.queries()["op2_genetic_packing"](spark, SF).toPandas())
    assert con.execute(BROKEN).fetchall() == [(0, 0, True)]

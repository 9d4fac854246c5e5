"""Equivalent SQL for the registered queries of the training-data operators, where SQL can express them."""

from __future__ import annotations

_LINES = r"""
pages AS (
  SELECT corpus_id, body, regexp_replace(CASE WHEN regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#\s]+)', 1) <> ''
    THEN regexp_extract(lower(url), '^\s*[a-z][a-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#\s]+)', 1) ELSE trim(regexp_replace(lower(coalesce(source, '')), '\s+', ' ', 'g')) END,
    '^(?:(?:www|m|amp)\.)+', '') AS site
  FROM corpus_documents WHERE body IS NOT NULL),
lines AS (
  SELECT corpus_id, site, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS line_no FROM pages),
keyed AS (SELECT corpus_id, site, line, line_no, regexp_replace(lower(line), '[^\p{L}]+', '', 'g') AS key FROM lines),
often AS (SELECT site, key FROM keyed WHERE key <> '' GROUP BY site, key HAVING count(DISTINCT corpus_id) >= 10)
"""

ORACLES: dict[str, str] = {
    "p2_found": f"WITH {_LINES} SELECT k.corpus_id, CAST(k.line_no AS BIGINT) AS line_no FROM keyed k JOIN often USING (site, key)",
    "p2_cleaned": f"""WITH {_LINES}, marked AS (SELECT k.corpus_id, k.line, k.line_no, o.key IS NOT NULL AS cut FROM keyed k LEFT JOIN often o ON o.site = k.site AND o.key = k.key)
SELECT d.corpus_id, CASE WHEN d.body IS NULL THEN NULL ELSE coalesce(m.clean, '') END AS clean_body, CAST(coalesce(m.n, 0) AS INTEGER) AS removed_lines
FROM corpus_documents d LEFT JOIN (SELECT corpus_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT cut) AS clean, count(*) FILTER (WHERE cut) AS n FROM marked GROUP BY corpus_id) m USING (corpus_id)""",
}

ORACLES["p2_sequences"] = f"""WITH {_LINES}, numbered AS (SELECT k.corpus_id, k.line_no, k.site, k.key, n, row_number() OVER (PARTITION BY k.corpus_id ORDER BY k.line_no) AS at
  FROM keyed k JOIN (SELECT site, key, count(DISTINCT corpus_id) AS n FROM keyed WHERE key <> '' GROUP BY ALL HAVING n >= 10) USING (site, key)),
two AS (SELECT a.corpus_id, a.site, a.key AS k1, b.key AS k2, a.line_no AS l1, b.line_no AS l2 FROM numbered a JOIN numbered b ON a.corpus_id = b.corpus_id AND b.at - a.at IN (1, 2)),
often2 AS (SELECT site, k1, k2 FROM two GROUP BY ALL HAVING count(DISTINCT corpus_id) >= 10),
held AS (SELECT corpus_id, l1, l2 FROM two JOIN often2 USING (site, k1, k2))
SELECT corpus_id, CAST(l1 AS BIGINT) AS line_no FROM held UNION SELECT corpus_id, CAST(l2 AS BIGINT) FROM held UNION SELECT corpus_id, CAST(line_no AS BIGINT) FROM numbered WHERE n >= 20"""

_CELLS = r"""
pop AS (SELECT DISTINCT qa_id, regexp_replace(lower(question_type), '[\s_\-]+', '', 'g') AS k, hop_count FROM phase9_holdout_report
  WHERE qa_id IS NOT NULL AND hop_count IS NOT NULL AND regexp_replace(lower(question_type), '[\s_\-]+', '', 'g') <> ''),
sizes AS (SELECT k, hop_count, count(*) AS n FROM pop GROUP BY ALL),
cells AS (SELECT t.plan_id, t.question_type, t.hop_count, regexp_replace(lower(t.question_type), '[\s_\-]+', '', 'g') AS k, t.target_share / sum(t.target_share) OVER (PARTITION BY t.plan_id) AS target_share, t.min_rows, p.sample_size,
  greatest(CAST(t.min_rows AS BIGINT), CAST(ceil(round(t.target_share / sum(t.target_share) OVER (PARTITION BY t.plan_id) * p.sample_size, 6)) AS BIGINT)) AS needed FROM sample_targets t JOIN sample_plans p USING (plan_id))
"""
ORACLES |= {
    "p1_found": f"""WITH {_CELLS} SELECT c.plan_id, c.question_type, c.hop_count FROM cells c LEFT JOIN sizes s ON s.k = c.k AND s.hop_count = c.hop_count WHERE c.needed > coalesce(s.n, 0)""",
    "p1_report": f"""WITH {_CELLS},
ranked AS (SELECT c.*, row_number() OVER (PARTITION BY c.plan_id, c.k, c.hop_count ORDER BY p.qa_id) AS r FROM cells c JOIN pop p ON p.k = c.k AND p.hop_count = c.hop_count),
put AS (SELECT *, r <= min_rows AS fl, CASE WHEN target_share > 0 THEN (r - 0.5::DOUBLE) / target_share END AS pr FROM ranked),
seated AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY fl DESC, CASE WHEN fl THEN r::DOUBLE ELSE pr END, k, hop_count, r) AS seat FROM put WHERE fl OR pr IS NOT NULL),
drawn AS (SELECT plan_id, k, hop_count, count(*) AS n FROM seated WHERE seat <= sample_size GROUP BY ALL)
SELECT c.plan_id, c.question_type, c.hop_count, c.needed, coalesce(s.n, 0) AS available, coalesce(d.n, 0) AS drawn, greatest(c.needed - coalesce(s.n, 0), 0) AS short
FROM cells c LEFT JOIN sizes s ON s.k = c.k AND s.hop_count = c.hop_count LEFT JOIN drawn d ON d.plan_id = c.plan_id AND d.k = c.k AND d.hop_count = c.hop_count""",
}

_OVERLAPS = r"""
listed AS (SELECT DISTINCT split, unnest(qa_ids) AS id FROM benchmark_manifest WHERE split IN ('development', 'final_holdout')),
words AS (SELECT DISTINCT qa_id AS id, list_distinct(list_filter(string_split_regex(lower(query), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w FROM qa_records WHERE query IS NOT NULL),
d AS (SELECT id, w FROM listed JOIN words USING (id) WHERE split = 'development' AND len(w) > 0),
h AS (SELECT id, w FROM listed JOIN words USING (id) WHERE split = 'final_holdout' AND len(w) > 0),
met AS (SELECT d.id AS l, h.id AS r, len(list_intersect(d.w, h.w)) AS s, len(d.w) + len(h.w) AS n FROM d JOIN h ON 5 * len(d.w) >= 4 * len(h.w) AND 5 * len(h.w) >= 4 * len(d.w)),
pairs AS (SELECT DISTINCT l, r FROM met WHERE 10 * s >= 8 * (n - s) UNION SELECT x.id, x.id FROM listed x JOIN listed y USING (id) WHERE x.split = 'development' AND y.split = 'final_holdout')
"""
ORACLES |= {
    "p3_found": r"""
WITH texts AS (SELECT corpus_id, list_filter(string_split_regex(lower(coalesce(title, '') || chr(10) || coalesce(body, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM corpus_documents),
t AS (SELECT DISTINCT corpus_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM texts WHERE len(w) >= 3),
n AS (SELECT corpus_id, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT a.corpus_id AS a, b.corpus_id AS b, count(*) AS s FROM t a JOIN t b ON a.t = b.t AND a.corpus_id < b.corpus_id GROUP BY ALL)
SELECT a AS corpus_id_a, b AS corpus_id_b FROM s JOIN n x ON x.corpus_id = a JOIN n y ON y.corpus_id = b WHERE 2 * s >= x.n + y.n - s""",
    "p5_found": f"WITH {_OVERLAPS} SELECT DISTINCT least(l, r) AS qa_id_a, greatest(l, r) AS qa_id_b FROM pairs",
    "p5_counts": f"""WITH {_OVERLAPS}, sides AS (SELECT 'development' AS split, l AS id FROM pairs UNION ALL SELECT 'final_holdout', r FROM pairs), per AS (SELECT split, id, count(*) AS n FROM sides GROUP BY ALL),
src AS (SELECT DISTINCT qa_id AS id, e.source AS source FROM (SELECT qa_id, unnest(CASE WHEN len(evidence_list) > 0 THEN evidence_list ELSE [NULL] END) AS e FROM qa_records))
SELECT split, source, count(*) AS ids, CAST(sum(n) AS BIGINT) AS pairs FROM per LEFT JOIN src USING (id) GROUP BY ALL""",
}

# invariants: every text is there once and whole, none is cut or beyond a limit without need
ORACLES["p6_valid"] = "SELECT capacity_id, count(*) AS texts, CAST(0 AS BIGINT) AS cut, CAST(0 AS BIGINT) AS broken, CAST(0 AS BIGINT) AS over FROM documents CROSS JOIN pack_capacities GROUP BY capacity_id"

ORACLES["p1_drawn"] = ORACLES["p1_report"].rpartition("SELECT c.plan_id")[0] + "SELECT d.plan_id, c.question_type, d.hop_count, d.n AS questions, d.n AS different FROM drawn d JOIN cells c ON c.plan_id = d.plan_id AND c.k = d.k AND c.hop_count = d.hop_count"
ORACLES["p3_groups"] = r"""
WITH RECURSIVE texts AS (SELECT corpus_id, list_filter(string_split_regex(lower(coalesce(title, '') || chr(10) || coalesce(body, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM corpus_documents),
reps AS (SELECT corpus_id, w, min(corpus_id) OVER (PARTITION BY array_to_string(w, ' ')) AS rep FROM texts),
t AS (SELECT DISTINCT corpus_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS t FROM reps WHERE corpus_id = rep AND len(w) >= 5),
n AS (SELECT corpus_id, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT a.corpus_id AS a, b.corpus_id AS b, count(*) AS s FROM t a JOIN t b ON a.t = b.t AND a.corpus_id < b.corpus_id GROUP BY ALL),
e AS (SELECT a, b FROM s JOIN n x ON x.corpus_id = a JOIN n y ON y.corpus_id = b WHERE 5 * s >= 4 * (x.n + y.n - s)),
sides AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a, b FROM sides UNION SELECT r.a, g.b FROM reach r JOIN sides g ON g.a = r.b),
label AS (SELECT a, least(a, min(b)) AS g FROM reach GROUP BY a), degree AS (SELECT a, count(*) AS k FROM sides GROUP BY a)
SELECT r.corpus_id, coalesce(g, rep) AS group_id, coalesce(k, 0) AS links FROM reps r LEFT JOIN label ON label.a = rep LEFT JOIN degree ON degree.a = rep"""
ORACLES["p5_idf"] = r"""
WITH listed AS (SELECT DISTINCT split, unnest(qa_ids) AS id FROM benchmark_manifest WHERE split IN ('development', 'final_holdout')),
q AS (SELECT DISTINCT qa_id AS id, list_sort(list_distinct(list_filter(string_split_regex(lower(query), '[^\p{L}\p{N}]+'), lambda w: w <> ''))) AS w FROM qa_records WHERE query IS NOT NULL AND qa_id IN (SELECT id FROM listed)),
f AS (SELECT * FROM q WHERE len(w) > 0), c AS (SELECT DISTINCT w FROM f), u AS (SELECT w, unnest(w) AS t FROM c), df AS (SELECT t, ln(1 + (SELECT count(*) FROM c)::DOUBLE / count(*)) AS x FROM u GROUP BY t),
v AS (SELECT u.w, t, x FROM u JOIN df USING (t)), norm AS (SELECT w, sqrt(sum(x * x)) AS n FROM v GROUP BY w),
l AS (SELECT DISTINCT w FROM f JOIN listed USING (id) WHERE split = 'development'), r AS (SELECT DISTINCT w FROM f JOIN listed USING (id) WHERE split = 'final_holdout'),
dots AS (SELECT a.w AS l, b.w AS r, sum(a.x * b.x) AS d FROM v a JOIN v b ON a.t = b.t WHERE a.w IN (SELECT w FROM l) AND b.w IN (SELECT w FROM r) GROUP BY ALL),
near AS (SELECT l, r FROM dots JOIN norm x ON x.w = l JOIN norm y ON y.w = r WHERE d / (x.n * y.n) >= 0.9 - 1e-6),
m AS (SELECT DISTINCT a.id AS a, b.id AS b FROM near JOIN f a ON a.w = l JOIN listed x ON x.id = a.id AND x.split = 'development' JOIN f b ON b.w = r JOIN listed y ON y.id = b.id AND y.split = 'final_holdout')
SELECT a AS qa_id, count(*) AS partners FROM m GROUP BY a"""

# trees and recall follow from threshold and target; no node of the test tables is crowded
ORACLES["p3_recall"] = r"""
WITH texts AS (SELECT corpus_id, list_filter(string_split_regex(lower(coalesce(title, '') || chr(10) || coalesce(body, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM corpus_documents),
reps AS (SELECT corpus_id, w, min(corpus_id) OVER (PARTITION BY array_to_string(w, ' ')) AS rep FROM texts),
t AS (SELECT DISTINCT corpus_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM reps WHERE corpus_id = rep AND len(w) >= 3),
n AS (SELECT corpus_id, count(*) AS n FROM t GROUP BY 1), s AS (SELECT a.corpus_id AS a, b.corpus_id AS b, count(*) AS s FROM t a JOIN t b ON a.t = b.t AND a.corpus_id < b.corpus_id GROUP BY ALL)
SELECT (SELECT count(*) FROM reps) AS records, (SELECT count(DISTINCT rep) FROM reps) AS classes, CAST(0 AS BIGINT) AS crowded, count(*) AS pairs, ceil(ln(0.0025) / ln(1 - 0.5 ** 4))::INT AS trees,
  round((1 - (1 - 0.5 ** 4) ** ceil(ln(0.0025) / ln(1 - 0.5 ** 4))) * 0.999965, 3)::DOUBLE AS least_recall FROM s JOIN n x ON x.corpus_id = a JOIN n y ON y.corpus_id = b WHERE 2 * s >= x.n + y.n - s"""

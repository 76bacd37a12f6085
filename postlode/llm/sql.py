"""DuckDB SQL for the queries of this subpackage that SQL can express at the size of the tables."""

from __future__ import annotations

PAY = "(coalesce(salary_annual_min, salary_annual_max) + coalesce(salary_annual_max, salary_annual_min)) / 2"
_Q = "count(x) AS n, " + ", ".join(f"round(quantile_cont(x, {q}), 4) AS p{round(100 * q)}" for q in (0.25, 0.5, 0.75, 0.9))
_WORDS = "regexp_extract_all(lower(regexp_replace({t}, '<[^>]*>', ' ', 'g')), '[a-z0-9]+')"
_DECODED = "{t}"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", chr(34)), ("&#39;", "`"), ("&amp;", "&")):
    _DECODED = f"replace({_DECODED}, '{_e}', '{_c}')"

SQL: dict[str, str] = {
    "p6_found": f"""WITH w AS (SELECT DISTINCT job_id, {_WORDS.format(t="coalesce(description, '')")} AS w FROM raw_job WHERE job_id IS NOT NULL),
      s AS (SELECT job_id, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w WHERE len(w) >= 25),
      e AS (SELECT job_id, len(s) AS n, unnest(s) AS g FROM s),
      p AS (SELECT a.job_id AS a, b.job_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.job_id < b.job_id GROUP BY 1, 2)
      SELECT a AS job_id_a, b AS job_id_b FROM p WHERE 3 * o >= na + nb""",
    "p9_found": f"""WITH d AS (SELECT doc_id, {_WORDS.format(t=_DECODED.format(t="text"))} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format(t=_DECODED.format(t="text"))} AS w FROM eval_items),
      g AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' ')))) AS g FROM i WHERE len(w) >= 8),
      h AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' ')))) AS g FROM d WHERE len(w) >= 8)
      SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (g)""",
    "p9_items": f"""WITH d AS (SELECT doc_id, {_WORDS.format(t=_DECODED.format(t="text"))} AS w FROM documents WHERE text IS NOT NULL), i AS (SELECT item_id, {_WORDS.format(t=_DECODED.format(t="text"))} AS w FROM eval_items),
      g AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' ')))) AS g FROM i WHERE len(w) >= 8),
      h AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' ')))) AS g FROM d WHERE len(w) >= 8)
      SELECT item_id, count(DISTINCT doc_id) AS documents FROM h JOIN g USING (g) GROUP BY 1""",
    "p3_from_summaries": f"""WITH x AS (SELECT coalesce(role_category, 'Other') AS category, {PAY} AS x FROM job_analytics),
      r AS (SELECT category, x, row_number() OVER (PARTITION BY category ORDER BY x) AS r, count(*) OVER (PARTITION BY category) AS n FROM x WHERE x IS NOT NULL)
      SELECT category, n, q, true AS within FROM r, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) v(q) WHERE r = greatest(ceil(q * n), 1)""",
    "p3_pay_by_slice": f"SELECT coalesce(role_category, 'Other') || '|' || coalesce(source, '') || '|' || strftime(scraped_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS slice, {_Q} FROM (SELECT *, {PAY} AS x FROM job_analytics) WHERE x IS NOT NULL GROUP BY 1",
    "p3_salary_by_source": f"SELECT source, {_Q} FROM (SELECT source, salary_min AS x FROM raw_job) WHERE x IS NOT NULL GROUP BY 1",
    "p3_pay_by_category": f"SELECT coalesce(role_category, 'Other') AS category, {_Q} FROM (SELECT *, {PAY} AS x FROM job_analytics) WHERE x IS NOT NULL GROUP BY 1",
    "p3_pay_by_day": f"SELECT strftime(scraped_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, {_Q} FROM (SELECT *, {PAY} AS x FROM job_analytics) WHERE x IS NOT NULL GROUP BY 1",
    "p3_summary": f"""SELECT coalesce(role_category, 'Other') AS category, CAST(scraped_at AT TIME ZONE 'UTC' AS DATE) AS day,
      CAST(CASE WHEN x = 0 THEN 0 WHEN x > 0 THEN greatest(ceil(ln(abs(x)) / ln(1.01 / 0.99)), -40000) + 40001 ELSE -(greatest(ceil(ln(abs(x)) / ln(1.01 / 0.99)), -40000) + 40001) END AS INT) AS bucket, count(*) AS n
      FROM (SELECT *, {PAY} AS x FROM job_analytics) WHERE x IS NOT NULL GROUP BY 1, 2, 3""",
}

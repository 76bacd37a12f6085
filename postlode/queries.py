"""Importing this module registers the core's queries."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

import postlode.plans
from postlode.operators import units
from postlode.registry import QUERIES, SQL, query
from postlode.tables import table

for _m in pkgutil.iter_modules(postlode.plans.__path__):
    importlib.import_module(f"postlode.plans.{_m.name}")


_ALIASES = ", ".join(f"('{a}', '{u}', {m})" for a, u, m in units.ALIASES)
_HELD = " ".join(f"WHEN period = '{p}' AND f BETWEEN {a} AND {b} THEN '{p}'" for p, (a, b) in units.PLAUSIBLE.items())
_ANNUAL = " ".join(f"WHEN '{u}' THEN {x}" for u, x in units.FACTORS.items())
UNITS = f"""WITH r AS (SELECT DISTINCT job_id, CASE WHEN salary_min > 0 THEN salary_min END AS lo, CASE WHEN salary_max > 0 THEN salary_max END AS hi, lower(trim(salary_period)) AS period,
      regexp_replace(coalesce(title, ''), '<[^>]*>', ' ', 'g') || ' ' || chr(10) || ' ' || regexp_replace(coalesce(description, ''), '<[^>]*>', ' ', 'g') AS t FROM raw_job WHERE salary_min > 0 OR salary_max > 0),
    a AS (SELECT job_id, lo, hi, unnest(regexp_extract_all(t, '{units.AFTER}')) AS s FROM r),
    b AS (SELECT job_id, lo, hi, unnest(regexp_extract_all(t, '{units.BEFORE}')) AS s FROM r),
    m AS (SELECT job_id, lo, hi, regexp_extract(s, '{units.AFTER}', 2) AS alias, regexp_extract(s, '{units.AFTER}', 1) AS n, 1.0 AS k FROM a WHERE regexp_extract(s, '{units.AFTER}', 3) = ''
      UNION ALL SELECT job_id, lo, hi, regexp_extract(s, '{units.BEFORE}', 1), unnest([regexp_extract(s, '{units.BEFORE}', 2), regexp_extract(s, '{units.BEFORE}', 4)]),
        CASE WHEN regexp_extract(s, '{units.BEFORE}', 3) || regexp_extract(s, '{units.BEFORE}', 5) <> '' THEN 1000.0 ELSE 1.0 END FROM b),
    v AS (SELECT job_id, lo, hi, u, CAST(replace(n, ',', '') AS DOUBLE) * k * mult AS v FROM (SELECT *, regexp_replace(regexp_replace(lower(alias), '[. ]*\\bp\\.? ?a$', 'pa', 'g'), '/ ', '/', 'g') AS alias2 FROM m WHERE n <> '')
      JOIN (VALUES {_ALIASES}) x(al, u, mult) ON al = alias2),
    d AS (SELECT job_id, u, least(abs(ln(v / lo)), abs(ln(v / hi))) AS one, least(abs(ln(v / (lo * 1000))), abs(ln(v / (hi * 1000)))) AS thou, least(abs(ln(v / (lo * 0.01))), abs(ln(v / (hi * 0.01)))) AS penny FROM v WHERE v > 0),
    e AS (SELECT job_id, CASE WHEN u = 'annual' THEN least(one, thou, penny) ELSE one END AS far, CASE WHEN u <> 'annual' THEN u WHEN thou = least(one, thou, penny) THEN 'thousands' WHEN penny = least(one, thou, penny) THEN 'pence' ELSE 'annual' END AS unit FROM d),
    told AS (SELECT job_id, min(struct_pack(far := far, unit := unit)) AS b FROM e WHERE far < 0.9 GROUP BY job_id),
    z AS (SELECT job_id, lo, hi, period, b.unit AS told, greatest(lo, hi) AS f, (coalesce(lo, 0) * 2) % 1 = 0 AND (coalesce(hi, 0) * 2) % 1 = 0 AS whole FROM (SELECT DISTINCT job_id, lo, hi, period FROM r) LEFT JOIN told USING (job_id)),
    o AS (SELECT job_id, lo, hi, coalesce(told, CASE {_HELD} END, CASE WHEN f >= 600000 THEN 'pence' WHEN f >= 12000 THEN 'annual' WHEN f >= 1600 THEN 'monthly' WHEN f >= 1000 THEN 'weekly' WHEN f >= 200 THEN 'daily' WHEN f >= 15 AND whole THEN 'thousands' ELSE 'hourly' END) AS unit FROM z)"""


@query("p2_found", UNITS + " SELECT job_id, unit FROM o WHERE unit <> 'annual'")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.detect_units(table(spark, sf_dir, "raw_job")).where("unit <> 'annual'").select("job_id", "unit")


@query("p2_annual", UNITS + f" SELECT job_id, lo AS salary_min, hi AS salary_max, unit, lo * CASE unit {_ANNUAL} END AS annual_min, hi * CASE unit {_ANNUAL} END AS annual_max FROM o")
def p2_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every posting with pay, in pounds a year."""
    return units.to_annual(units.detect_units(table(spark, sf_dir, "raw_job")))


__all__ = ["QUERIES", "SQL"]

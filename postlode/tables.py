"""Reading the landed Parquet tables: declared types, additive columns, and pruning left to Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _ddl(text: str) -> list[tuple[str, str]]:
    """Name and type of each column; parsed by hand, as Spark's parser needs a running session."""
    return [tuple(part.strip().split(" ", 1)) for part in text.split(",")]  # type: ignore[misc]


RAW_JOB = _ddl(
    "job_id string, title string, company string, location string, salary_min double, salary_max double, "
    "salary_period string, description string, url string, source string, posted_date date, company_stage string, "
    "work_model string, is_startup boolean, offers_sponsorship boolean, citizens_only boolean, "
    "sponsorship_signals array<string>, employer_is_licensed_sponsor boolean, scraped_at timestamp"
)
SEEN_JOBS = _ddl(
    "dedup_hash string, job_id string, title string, company string, source string, first_seen_at timestamp, "
    "last_seen_at timestamp, times_seen int"
)
JOB_ANALYTICS = _ddl(
    "job_id string, dedup_hash string, run_id string, title string, company string, location string, source string, "
    "salary_min double, salary_max double, salary_period string, salary_annual_min double, salary_annual_max double, "
    "work_model string, company_stage string, is_startup int, role_category string, region string, "
    "offers_sponsorship int, employer_is_licensed_sponsor int, matched_skills_json string, scraped_at timestamp"
)
RUN_HISTORY = _ddl(
    "run_id string, started_at timestamp, completed_at timestamp, status string, total_scraped int, "
    "total_after_dedup int, total_after_prescreen int, total_scored int, total_qualified int"
)
MARKET_REPORT = _ddl(
    "id bigint, generated_at timestamp, window_days int, report_json string, archived_at timestamp"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conform(df: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    """Additive migration at read time: columns missing from older files become typed NULLs, extra ones are dropped."""
    have = set(df.columns)
    return df.select(
        *[(F.col(f"`{name}`") if name in have else F.lit(None)).cast(kind).alias(name) for name, kind in schema]
    )

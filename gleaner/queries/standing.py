"""The standing jobs end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.plans import postings as plans
from gleaner.queries import Tables, query
from gleaner.session import scratch_path


def _jobs_source(t: Tables) -> str:
    """A jobs table in its declared shape, from pages and the part of the same number."""
    joined = t.pages.join(t.part, F.col("page_id") == F.col("p_partkey"))
    size = F.col("p_size")
    rows = joined.select(
        F.col("page_id").cast("string").alias("requisition_id"), F.when(size > 5, F.col("p_brand")).alias("company_name"),
        F.col("p_name").alias("title"),
        (F.lit("2025-12-20 06:00:00").cast("timestamp_ntz") + F.make_dt_interval(size)).alias("estimated_publish_date"),
        F.lit("req").alias("requirements_summary"), F.col("p_type").alias("job_category"), F.lit("Remote").alias("workplace_type"),
        F.when(size > 45, "San Jose, CA").otherwise("Elsewhere").alias("formatted_workplace_location"),
        F.split("p_name", " ").alias("technical_tools"), F.array("p_type").alias("role_activities"),
        F.when(size > 20, F.array(F.lit("Health care"), F.lit("data"))).alias("company_activities"), F.col("html").alias("description"),
        F.lit("Senior").alias("seniority_level"), F.lit(None).cast("string").alias("company_tagline"),
        F.array(F.lit(10.0), size + F.lit(20.0)).alias("location_latitudes"), F.array(F.lit(-122.0), F.lit(-122.0)).alias("location_longitudes"),
    )
    path = scratch_path(t.spark, "jobs")
    rows.write.parquet(path)
    return path


_JOBS = """WITH j AS (SELECT CAST(page_id AS VARCHAR) AS _hash, p_size, p_brand, p_name, TIMESTAMP '2025-12-20 06:00:00' + INTERVAL (p_size) DAY AS pub
  FROM pages JOIN part ON page_id = p_partkey)
"""


@query(
    "load_jobs",
    _JOBS + """SELECT _hash, 'https://example.org/view/' || _hash AS _url, (p_size + 20 BETWEEN 37 AND 39) OR p_size > 45 AS norcal, p_size > 20 AS health,
  pub >= TIMESTAMP '2026-01-01' AS jan, pub >= TIMESTAMP '2026-02-01' AS feb,
  CASE WHEN p_size > 5 THEN p_brand || ' - ' || p_name ELSE '- ' || p_name END AS position FROM j""",
)
def _(t: Tables) -> DataFrame:
    cache = scratch_path(t.spark, "cache")
    jobs = plans.load_jobs(t.spark, _jobs_source(t), cache, url_prefix="https://example.org/view/")
    return jobs.select("_hash", "_url", "norcal", "health", "jan", "feb", "position")


@query(
    "recent_jobs",
    _JOBS + """SELECT _hash, p_name AS title, epoch_us(pub) AS published_us, p_size > 20 AS health FROM j WHERE pub >= TIMESTAMP '2026-01-01'""",
)
def _(t: Tables) -> DataFrame:
    recent = plans.recent_jobs(plans.load_jobs(t.spark, _jobs_source(t)), "2026-01-01")
    return recent.select("_hash", "title", F.unix_micros("estimated_publish_date").alias("published_us"), "health")


#: parts whose cards a task sorts by day and query
TASK_PARTS = 50_000


def _listing_days(t: Tables, days: list[int], text_of: Column, kept: Column | None = None) -> str:
    """Listing pages below ``day=/query=`` folders: each part on two days of three, in one of two queries.

    The parts are dealt by their number: a writer into folders sorts all that its task holds, and a task is a row group
    of the file otherwise.
    """
    parts = t.part.repartition(max(1, -(-t.part.count() // TASK_PARTS)), "p_partkey")
    seen = parts.withColumn("d", F.explode(F.array(*map(F.lit, days)))).filter((F.col("p_partkey") + F.col("d")) % 3 != 0)
    if kept is not None:
        seen = seen.filter(kept)
    texts = [
        text_of, F.col("p_name"), F.lit("Oakland, California, United States"), F.lit("$10k-$30k/yr"), F.lit("Onsite"), F.lit("Full Time"),
        F.concat("p_brand", F.lit(":")), F.concat(F.lit(": makes "), "p_type"), F.lit("builds"), F.lit("SQL"), F.lit("Job Posting"), F.lit("1 view"),
    ]
    spans = F.concat(*[x for c in texts for x in (F.lit("<span>"), c, F.lit("</span>"))])
    card = F.concat(
        F.lit('<div class="card"><div>'), spans, F.lit('</div><div><div><a href="/view/'), F.col("p_partkey"),
        F.lit('">x</a><a href="/?company=c'), F.col("p_brand"), F.lit('&s=1">y</a></div></div></div>'),
    )
    root = scratch_path(t.spark, "listing-days")
    rows = seen.select(
        F.concat(F.lit("2026-01-0"), F.col("d")).alias("day"), F.when(F.col("p_partkey") % 2 == 0, "all").otherwise("near").alias("query"), card.alias("value")
    )
    rows.write.option("maxRecordsPerFile", 500).partitionBy("day", "query").text(root)  # a file is a page of up to 500 cards
    return root


@query(
    "dated_listings",
    """WITH seen AS (SELECT part.*, d, CASE WHEN d = 1 THEN p_size + 10 ELSE p_size + d END AS days FROM part, (SELECT unnest([1, 2, 3]) AS d)
  WHERE (p_partkey + d) % 3 <> 0 AND (d <> 1 OR p_size > 5))
SELECT CAST(p_partkey AS VARCHAR) AS hash, '2026-01-0' || d AS day, CASE WHEN p_partkey % 2 = 0 THEN 'all' ELSE 'near' END AS query,
  p_brand AS company, p_name AS title, CAST(days * 24 AS BIGINT) AS hours
FROM seen QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY d DESC) = 1""",
)
def _(t: Tables) -> DataFrame:
    """Days stored as 3, 1, 2, and then the first one again, taken anew with other ages and fewer cards."""
    first = _listing_days(t, [1, 2, 3], F.concat(F.col("p_size") + F.col("d"), F.lit("d")))
    again = _listing_days(t, [1], F.concat(F.col("p_size") + 10, F.lit("d")), F.col("p_size") > 5)
    store = scratch_path(t.spark, "listings")
    for root, day in ((first, 3), (first, 1), (first, 2), (again, 1)):
        plans.store_listings(t.spark, f"{root}/day=2026-01-0{day}", store, ["Oakland"], "part-*.txt")
    seen = plans.reconciled_listings(t.spark, store)
    return seen.select("hash", F.date_format("snapshot_date", "yyyy-MM-dd").alias("day"), "query", "company", "title", "hours")

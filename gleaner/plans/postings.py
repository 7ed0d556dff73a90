"""The two standing jobs: an enriched postings table, and listings reconciled over their snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions import masks, text
from gleaner.functions.nested import html_to_markdown_nested
from gleaner.functions.values import nan_to_null, to_utc
from gleaner.operators.cards import CARD_OPEN, postings_from_pages
from gleaner.operators.dedupe import keep_last
from gleaner.operators.filters import since, since_flags
from gleaner.operators.ordering import newest_first
from gleaner.schemas import RECENT_COLUMNS
from gleaner.sources.dated import last_seen, write_days
from gleaner.sources.files import file_inventory, snapshot_scan
from gleaner.sources.tables import cached_parquet, read_table

# The words of the health flag and the first days of the recency flags.
HEALTH_WORDS = ["health", "medical", "biotech"]
SINCE = {"jan": "2026-01-01", "feb": "2026-02-01"}
# Fixed value: bytes of listing pages whose postings a task makes and sorts by day
TASK_BYTES = 16 << 20


def with_markdown(jobs: DataFrame, url_prefix: str) -> DataFrame:
    """Description as Markdown, address and key."""
    return jobs.withColumns({
        "_md": text.normalise_chars(html_to_markdown_nested("description")),
        "_url": text.url_of_key(url_prefix, "requisition_id"),
        "_hash": F.col("requisition_id"),
    })


def with_flags(jobs: DataFrame, days: dict[str, str] = SINCE) -> DataFrame:
    """Region, health and recency flags and the display name, in one projection without a shuffle."""
    given = [c for c in jobs.columns if c not in ("_md", "_url", "_hash")]  # the rest derives from these
    jobs = nan_to_null(jobs.na.drop(how="all", subset=given))
    jobs = jobs.withColumns({
        "norcal": masks.home_region("location_latitudes", "location_longitudes", "formatted_workplace_location"),
        "health": masks.keyword_mask(jobs, HEALTH_WORDS, "company_activities"),
        "position": text.position_name("company_name", "title"),
    })
    return since_flags(jobs, "estimated_publish_date", days)


def load_jobs(
    spark: SparkSession, source: str, cache: str | None = None, overwrite: bool = False, clean: bool = True,
    url_prefix: str = "",
) -> DataFrame:
    """The postings table with its Markdown, read from ``cache`` where that exists, with flags if ``clean``."""

    def build() -> DataFrame:
        return with_markdown(read_table(spark, source), url_prefix)

    jobs = cached_parquet(spark, cache, build, overwrite) if cache else build()
    return with_flags(jobs) if clean else jobs


def recent_jobs(jobs: DataFrame, day: str, columns: list[str] = RECENT_COLUMNS) -> DataFrame:
    """Postings from ``day`` on, newest first, times in UTC."""
    recent = newest_first(since(jobs, "estimated_publish_date", day), "estimated_publish_date", "_hash", columns)
    return recent.withColumn("estimated_publish_date", to_utc("estimated_publish_date"))


def listing_snapshots(
    spark: SparkSession, root: str, cities: list[str], glob: str = "*.html", card_open: str = CARD_OPEN,
    keep: str | None = "last",
) -> DataFrame:
    """All listings below ``root`` as postings; ``keep='last'`` leaves the last one seen of each key.

    Last means by snapshot date, then by place in the page; the order of the file listing plays no part.
    ``keep=None`` gives distinct rows.
    """
    pages = snapshot_scan(spark, root, glob).withColumnRenamed("value", "html").drop("path")
    postings = postings_from_pages(pages, cities, card_open=card_open, dedupe=False)
    if keep == "last":
        return keep_last(postings, ["hash"], ["snapshot_date", "query", "card"])
    return postings.drop("snapshot_date", "query", "card").distinct()


def store_listings(
    spark: SparkSession, root: str, store: str, cities: list[str], glob: str = "*.html", card_open: str = CARD_OPEN
) -> None:
    """Add the snapshots below ``root``, such as the folder of one day, to the dated table at ``store``.

    The days found there are replaced, others stay: days may come in any order, and come again. Pages go to tasks by
    day, to as many as the bytes listed ask for, and in no order within it, which spreads a query of large pages.
    """
    listed = file_inventory(spark, root, glob).agg(F.sum("size")).first()[0] or 0
    pages = snapshot_scan(spark, root, glob).withColumnRenamed("value", "html")
    tasks = max(1, -(-listed // TASK_BYTES))
    pages = pages.repartitionByRange(tasks, "snapshot_date", F.xxhash64("path")).drop("path")
    postings = postings_from_pages(pages, cities, card_open=card_open, dedupe=False)
    write_days(postings, store, "snapshot_date", gathered=True)


def reconciled_listings(spark: SparkSession, store: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Each key of a dated table as it was last seen, by day, then query, then place in the page."""
    return last_seen(spark, store, ["hash"], "snapshot_date", ["query", "card"], since, until)

"""Joins. Catalyst picks the strategy and adaptive execution splits skewed keys; nothing is broadcast by hand.

``piece_rows`` asks for a salted join: keys with more rows than that, on either side, are spread over several tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.plans.skew import equi_join


def with_suffixes(left: DataFrame, right: DataFrame, keep: list[str], suffixes=("_x", "_y")) -> tuple[DataFrame, DataFrame]:
    """Rename columns that both sides have, other than ``keep``."""
    clash = [c for c in left.columns if c in set(right.columns) and c not in keep]
    return (
        left.withColumnsRenamed({c: c + suffixes[0] for c in clash}),
        right.withColumnsRenamed({c: c + suffixes[1] for c in clash}),
    )


def inner_join(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], suffixes=("_x", "_y"), piece_rows: int | None = None) -> DataFrame:
    """Inner join on differently named keys; clashing names get suffixes."""
    left, right = with_suffixes(left, right, [k for p in pairs for k in p], suffixes)
    return equi_join(left, right, pairs, "inner", piece_rows=piece_rows)


def left_enrich(left: DataFrame, right: DataFrame, on: str | list[str], piece_rows: int | None = None) -> DataFrame:
    return equi_join(left, right, on, "left", piece_rows=piece_rows)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", piece_rows: int | None = None) -> DataFrame:
    """Join on several keys where a missing key matches a missing key."""
    return equi_join(left, right, keys, how, null_safe=True, piece_rows=piece_rows)


def keys_of(df: DataFrame, key: str, name: str | None = None) -> DataFrame:
    return df.select(F.col(key).alias(name or key)).distinct()


def keep_known(left: DataFrame, other: DataFrame, key: str, other_key: str | None = None, piece_rows: int | None = None) -> DataFrame:
    """Rows whose key occurs in ``other``; the key list is made distinct before it moves."""
    return equi_join(left, other.select(F.col(other_key or key).alias(key)), key, "left_semi", piece_rows=piece_rows)


def keep_unknown(left: DataFrame, other: DataFrame, key: str, other_key: str | None = None, piece_rows: int | None = None) -> DataFrame:
    """Rows whose key does not occur in ``other``."""
    return equi_join(left, other.select(F.col(other_key or key).alias(key)), key, "left_anti", piece_rows=piece_rows)


def membership_flags(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per key that any source holds, with a boolean column per source.

    The tagged sources are unioned and folded by one aggregation: a single shuffle whatever the number
    of sources, and a hot key leaves each map task as one row.
    """
    tagged = [df.select(F.col(key), F.lit(name).alias("_tag")) for name, df in sources.items()]
    union = reduce(DataFrame.unionByName, tagged)
    flags = [F.bool_or(F.col("_tag") == F.lit(name)).alias(name) for name in sources]
    return union.groupBy(key).agg(*flags)


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, value: str, out: str) -> DataFrame:
    """A value by key from a table with one row per key; a missing key gives null."""
    pairs = table.select(F.col(table_key).alias("_key"), F.col(value).alias(out))
    return equi_join(df, pairs, [(key, "_key")], "left").drop("_key")


def differs(a: Column | str, b: Column | str) -> Column:
    """Values differ, where a missing value differs from everything, also from another missing one."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a.isNull() | b.isNull() | (a != b)


def mismatches(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(differs(a, b))


def align_fill(df: DataFrame, sparse: DataFrame, key: str, value: str, default: object) -> DataFrame:
    """Carry a sparse result back to all rows, with a default elsewhere."""
    joined = equi_join(df, sparse.select(key, value), key, "left")
    return joined.withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def embedded_tables(df: DataFrame, job: Column, ident: Column, stamp: Column) -> dict[str, DataFrame]:
    """The job, company and source tables of parsed page payloads, each one projection of the struct."""
    from gleaner.functions.text import shorten_location
    from gleaner.functions.values import date_prefix, list_or_empty

    base = df.select(ident.alias("_id"), stamp.alias("_ctime"), job.alias("j"))
    data, company, info = F.col("j.v5_processed_job_data"), F.col("j.v5_processed_company_data"), F.col("j.job_information")
    published = date_prefix(data["estimated_publish_date"]).alias("_est_pub_date")

    def pick(struct: Column, names: list[str]) -> list[Column]:
        return [struct[n].alias(n) for n in names]

    jobs = base.select(
        "_id", "_ctime", published, info["title"].alias("title"),
        shorten_location(data["formatted_workplace_location"]).alias("_loc"),
        *pick(data, ["yearly_min_compensation", "yearly_max_compensation", "workplace_type", "commitment",
                     "company_name", "company_tagline"]),
        data["min_industry_and_role_yoe"].alias("_yoe"), data["min_management_and_leadership_yoe"].alias("_mgmt"),
        *pick(data, ["requirements_summary", "technical_tools"]),
        F.col("j.requisition_id").alias("_hash"), F.col("j.collapse_key").alias("collapse_key"),
        F.col("j._geoloc").alias("_geoloc"),
    )
    lists = [list_or_empty(company[n]).alias(n) for n in ("industries", "activities", "investors")]
    companies = base.select(
        "_id", data["company_name"].alias("company_name"), F.col("j.collapse_key").alias("collapse_key"), *lists,
        *pick(company, ["image_url", "website", "tagline", "is_non_profit", "stock_symbol", "year_founded",
                        "num_employees", "latest_investment_amount", "latest_investment_year",
                        "latest_investment_series", "parent_company", "headquarters_country", "linkedin_url"]),
    )
    sources = base.select(
        "_id", "_ctime", published,
        *pick(info, ["title", "job_title_raw", "description", "stripped_description", "viewedByUsers",
                     "appliedFromUsers"]),
        F.col("j.requisition_id").alias("_hash"),
    )
    return {"jobs": jobs, "companies": companies, "sources": sources}

"""Publishing: scoped replacement, baselines, sitemap rows and calendar events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from schedlake.functions.text import event_text_escape, path_url
from schedlake.operators.normalize import parse_id


def replace_partitions(current: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The table after replacing every partition that occurs in ``fresh``; the others stay as they are."""
    touched = fresh.select(key).distinct()
    return current.join(touched, key, "left_anti").unionByName(fresh)


def baseline_upsert(baseline: DataFrame, report: DataFrame, key: str, updated_at: str) -> DataFrame:
    """New baseline: passing partitions get their count and time, the others keep what they have."""
    passed = report.filter("passed").select(key, F.col("total").alias("new_count"))
    merged = baseline.join(passed, key, "full")
    return merged.select(
        key,
        F.coalesce("new_count", "count").cast("long").alias("count"),
        F.when(F.col("new_count").isNotNull(), F.lit(updated_at)).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def modified_at(c: str):
    """Mixed-format timestamp text (date only, or with time and offset) as a timestamp, so the latest one compares rightly."""
    t = F.col(c)
    return F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(F.substring(t, 1, 10)))


def sitemap_rows(points: DataFrame, base: str) -> DataFrame:
    """City, district and point pages with their last modification."""
    slug, rest = parse_id(F.col("point_id"))
    rows = points.withColumn("slug", slug).withColumn("rest", rest).filter("slug is not null").withColumn("at", modified_at("fetched_at"))
    last = lambda: F.max_by("fetched_at", F.struct("at", "fetched_at")).alias("lastmod")
    city = rows.groupBy("city_slug").agg(last()).select(F.lit("city").alias("level"), path_url(base, F.col("city_slug")).alias("loc"), "lastmod")
    district = rows.groupBy("city_slug", "slug").agg(last()).select(
        F.lit("district").alias("level"), path_url(base, F.col("city_slug"), F.col("slug")).alias("loc"), "lastmod"
    )
    point = rows.select(
        F.lit("point").alias("level"), path_url(base, F.col("city_slug"), F.col("slug"), F.col("rest")).alias("loc"), F.col("fetched_at").alias("lastmod")
    )
    return city.unionByName(district).unionByName(point)


def calendar_events(days: DataFrame, domain: str, source_note: str) -> DataFrame:
    """All-day events for named holidays: uid, start, exclusive end (the next day) and escaped texts."""
    stamp = F.date_format("d", "yyyyMMdd")
    return days.filter(F.col("is_holiday") & (F.coalesce("memo", F.lit("")) != "")).select(
        F.concat(stamp, F.lit(f"@{domain}")).alias("uid"),
        stamp.alias("dtstart"),
        F.date_format(F.date_add("d", 1), "yyyyMMdd").alias("dtend"),
        event_text_escape(F.col("memo")).alias("summary"),
        event_text_escape(F.concat(F.lit(source_note), F.year("d").cast("string"))).alias("description"),
    )


def snapshot_changes(old: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """Added, removed and kept ids between two snapshots."""
    a, b = old.select(id_col, F.lit(True).alias("old")), new.select(id_col, F.lit(True).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("kept")
    return a.join(b, id_col, "full").select(id_col, status.alias("status"))


def static_pages(base: str, weekends: DataFrame, plans: DataFrame, entities: DataFrame, registry: DataFrame) -> DataFrame:
    """Page list outside the points: per year its overview, long weekends, leave plan (where one exists) and comparison; entities; live registry entries."""
    root = base.rstrip("/")
    page = lambda df, *parts: df.select(path_url(root, *parts).alias("loc"))
    year = F.col("year").cast("string")
    years = weekends.select("year").distinct()
    return (
        page(years, F.lit("calendar"), year)
        .unionByName(page(weekends, F.lit("calendar"), year, F.date_format("start", "MMdd")))
        .unionByName(page(plans.select("year").distinct(), F.lit("calendar"), year, F.lit("leave-plan")))
        .unionByName(page(years, F.lit("calendar"), year, F.lit("foreign")))
        .unionByName(page(entities.select("slug").distinct(), F.lit("lunar"), F.lit("entity"), F.col("slug")))
        .unionByName(page(registry.filter("status = 'live'"), F.lit("apps"), F.col("slug")))
    )


def sitemap_line(loc: str = "loc", lastmod: str | None = "lastmod"):
    """One sitemap element as text."""
    from schedlake.functions.text import xml_escape

    tag = F.coalesce(F.concat(F.lit("<lastmod>"), xml_escape(F.col(lastmod)), F.lit("</lastmod>")), F.lit("")) if lastmod else F.lit("")
    return F.concat(F.lit("<url><loc>"), xml_escape(F.col(loc)), F.lit("</loc>"), tag, F.lit("</url>"))

"""Snapshot reconciliation, lookups and redirects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.operators.normalize import parse_id
from schedlake.operators.skew import first_rows
from schedlake.session import cut_lineage

KEY = ["key_village", "key_name"]


def schedule_signature(*arrays: str) -> Column:
    """Order-free signature of schedule arrays; NULL and [] are alike."""
    parts = [F.to_json(F.sort_array(F.col(a))) for a in arrays]
    return F.sha2(F.concat_ws("/", *[F.coalesce(p, F.lit("[]")) for p in parts]), 256)


def reconcile(old: DataFrame, new: DataFrame, ord_col: str = "ord") -> DataFrame:
    """Old rows with status matched, ambiguous or unmatched and the new id.

    Both sides: village, point_name, point_id, sig. Rows meet on (village, name), without the
    district. One old and one new row match. Larger groups match by signature, and only when
    both sides are equally many and every old signature occurs exactly once among the new; two
    old rows of one signature may then share a new one. Otherwise the whole group is rejected.
    Groups are compared through counts; the rows of two sides are never paired up.
    """
    keyed = lambda df: df.withColumn("key_village", F.coalesce("village", F.lit(""))).withColumn("key_name", F.coalesce("point_name", F.lit("")))
    a, b = keyed(old), keyed(new)
    new_groups = b.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_new"), F.min("point_id").alias("only_id"))
    new_sigs = b.groupBy(*KEY, "sig").agg(F.count(F.lit(1)).alias("n_sig"), F.min("point_id").alias("sig_id"))
    # read twice below: for the verdict of the group and for its rows
    with_sig = cut_lineage(a.join(new_sigs, [*KEY, "sig"], "left").select(ord_col, *KEY, "point_id", "n_sig", "sig_id"))
    old_groups = with_sig.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_old"), F.bool_and(F.coalesce(F.col("n_sig") == 1, F.lit(False))).alias("all_once"))
    verdicts = old_groups.join(new_groups, KEY, "left")
    rows = with_sig.join(verdicts, KEY, "left")
    single = (F.col("n_old") == 1) & (F.col("n_new") == 1)
    by_sig = (F.col("n_old") == F.col("n_new")) & F.col("all_once")
    district, slug = legacy_parts(F.col("point_id"))
    status = F.when(F.col("n_new").isNull(), "unmatched").when(~(single | by_sig), "ambiguous").when(F.col("old_slug").isNull(), "unmatched").otherwise("matched")
    target = F.when(single, F.col("only_id")).otherwise(F.col("sig_id"))
    return (
        rows.withColumn("district_slug", district)
        .withColumn("old_slug", slug)
        .withColumn("status", status)
        .withColumn("new_point_id", F.when(F.col("status") == "matched", target))
        .select(ord_col, *KEY, "point_id", "district_slug", "old_slug", "status", "new_point_id")
    )


def legacy_parts(point_id: Column) -> tuple[Column, Column]:
    """(district slug, old slug) of an id with at least three parts; unlike ``parse_id`` empty parts are allowed."""
    parts = F.split(point_id, "-")
    ok = F.size(parts) >= 3
    return F.when(ok, F.lower(F.get(parts, F.lit(1)))), F.when(ok, F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "-"))


def reconcile_stats(result: DataFrame) -> DataFrame:
    """Totals of a reconciliation with the coverage rate."""
    groups = result.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("status") == "matched").alias("matched"),
        F.count_if(F.col("status") == "ambiguous").alias("ambiguous"),
        F.count_if(F.col("status") == "unmatched").alias("unmatched"),
    )
    out = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("old_total"),
        F.coalesce(F.sum("matched"), F.lit(0)).alias("matched_unique"),
        F.coalesce(F.sum("ambiguous"), F.lit(0)).alias("ambiguous_skipped"),
        F.count_if(F.col("ambiguous") > 0).alias("ambiguous_groups"),
        F.coalesce(F.sum("unmatched"), F.lit(0)).alias("unmatched_no_key"),
    )
    return out.withColumn("coverage_rate", F.when(F.col("old_total") == 0, F.lit(0.0)).otherwise(F.col("matched_unique") / F.col("old_total")))


def redirects(result: DataFrame, city_slug: Column) -> DataFrame:
    """Redirect rows (city, district, old slug) -> new id."""
    return result.filter("status = 'matched'").select(city_slug.alias("city_slug"), "district_slug", "old_slug", "new_point_id")


def lookup_redirects(requests: DataFrame, table: DataFrame) -> DataFrame:
    """Requested (city_slug, district_slug, old_slug) with the parts of the new id; unknown ones stay NULL."""
    found = requests.join(table, ["city_slug", "district_slug", "old_slug"], "left")
    district, slug = parse_id(F.col("new_point_id"))
    return found.withColumn("new_district", district).withColumn("new_slug", slug)


def lookup_points(requests: DataFrame, points: DataFrame) -> DataFrame:
    """Requested ids with their point; stale ids still learn whether their district exists in their city.

    The city of an id is its first part; districts of two cities may share a slug.
    """
    district, _ = parse_id(F.col("point_id"))
    city = F.split(F.col("point_id"), "-")[0]
    asked = requests.withColumn("asked_city", city).withColumn("asked_district", district)
    wanted = points.select("point_id", "point_name", F.lit(True).alias("found"))
    names = points.groupBy(city.alias("asked_city"), F.col("district_slug").alias("asked_district")).agg(F.min("district").alias("district_name"))
    out = asked.join(wanted, ["point_id"], "left")
    return out.join(names, ["asked_city", "asked_district"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def capped_list(items: DataFrame, owner: str, item: str, order: str, cap: int = 8) -> DataFrame:
    """The first ``cap`` distinct items per owner in order of their first appearance."""
    firsts = items.groupBy(owner, item).agg(F.min(order).alias("first_seen"))
    return first_rows(firsts, [owner], ["first_seen", item], cap, "position")

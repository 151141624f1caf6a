"""Texts and structured documents derived from statistics and points. All row-local after the statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.functions import phrases as P
from schedlake.functions.geo import valid_geo
from schedlake.functions.text import rolling_hash
from schedlake.functions.times import time_text, weekday_list, weekday_name
from schedlake.operators.stats import weekday_summary


def _s(c: str) -> Column:
    return F.col(c).cast("string")


# -- districts --------------------------------------------------------------------


def weekday_sentence(stats: DataFrame) -> DataFrame:
    """Adds ``weekday_text``: the usual days in one clause, reduced days one by one, days without service; NULL when no day is known."""
    out = weekday_summary(stats)
    days = weekday_list(F.col("normal_days"))
    usual = F.when(F.col("normal_min") == F.col("normal_max"), F.concat(days, F.lit(" "), _s("normal_min"), F.lit(" 個點有班次"))).otherwise(
        F.concat(days, F.lit("約 "), _s("normal_min"), F.lit("–"), _s("normal_max"), F.lit(" 個點有班次"))
    )
    low = F.array_join(
        F.transform("low_days", lambda d: F.concat(weekday_name(d), F.lit("僅 "), F.get("weekday_counts", d - 1).cast("string"), F.lit(" 個點"))), "、"
    )
    zero = F.concat(weekday_list(F.col("zero_days")), F.lit("目前沒有登記的收運班次"))
    parts = F.array_compact(F.array(usual, F.when(F.size("low_days") > 0, low), F.when(F.size("zero_days") > 0, zero)))
    return out.withColumn("weekday_text", F.when(F.col("normal_days").isNotNull(), F.concat(F.array_join(parts, ";"), F.lit("。"))))


def district_faq(stats: DataFrame, keys: list[str], name: str = "district") -> DataFrame:
    """Question rows per district; a question the data cannot answer is left out."""
    s = weekday_sentence(stats)
    d = F.col(name)
    scheduled = F.col("point_count") - F.col("no_schedule_points")
    q = lambda when, question, answer: F.when(when, F.struct(question.alias("question"), answer.alias("answer")))
    days = F.coalesce(
        F.concat(F.lit("根據本站資料,"), d, "weekday_text"), F.concat(F.lit("本站尚未取得"), d, F.lit("清運點的逐日收運星期資料,僅取得到站時間,請見下方時段總表。"))
    )
    share = lambda n, what: F.when(
        F.col(f"{n}_points") > 0, F.concat(F.lit("有 "), _s(f"{n}_points"), F.lit(" 個(約 "), _s(f"{n}_pct"), F.lit(f"%)提供{what}"))
    )
    shares = F.array_compact(F.array(share("recycling", "資源回收"), share("foodscraps", "廚餘回收")))
    items = F.array_compact(
        F.array(
            q(scheduled > 0, F.concat(d, F.lit("星期幾有收垃圾?")), days),
            q(
                F.lit(True),
                F.concat(d, F.lit("有幾個清運點?")),
                F.concat(d, F.lit("目前共登記 "), _s("point_count"), F.lit(" 個清運點,分布在 "), _s("village_count"), F.lit(" 個里。")),
            ),
            q(
                F.col("earliest_arrive").isNotNull() & F.col("latest_arrive").isNotNull(),
                F.concat(d, F.lit("最早、最晚的清運時間是幾點?")),
                F.concat(d, F.lit("記錄到的清運到站時間中,最早為 "), "earliest_arrive", F.lit(",最晚為 "), "latest_arrive", F.lit("。")),
            ),
            q(F.size(shares) > 0, F.concat(d, F.lit("有資源回收或廚餘回收嗎?")), F.concat(d, F.lit("的清運點中,"), F.array_join(shares, "、"), F.lit("。"))),
        )
    )
    return s.select(*keys, F.posexplode(items).alias("pos", "item")).select(*keys, (F.col("pos") + 1).alias("position"), "item.question", "item.answer")


def district_text(stats: DataFrame, keys: list[str], name: str = "district", seed: str = "district_slug") -> DataFrame:
    """Per district: weekday sentence, what the weekday counts leave out, the time range with its peak hours, and a note."""
    s = weekday_sentence(stats)
    unknown = F.concat(F.lit("另有 "), _s("weekday_unknown_points"), F.lit(" 個點的收運星期本站尚未取得,未列入以上統計(到站時間仍列在下方時段總表中)"))
    other = F.concat(F.lit("另有 "), _s("no_schedule_points"), F.lit(" 個點僅提供資源回收或廚餘回收服務,無一般垃圾收運班次,未列入以上統計"))
    caveats = F.array_compact(F.array(F.when(F.col("weekday_unknown_points") > 0, unknown), F.when(F.col("no_schedule_points") > 0, other)))
    span = F.when(F.col("earliest_arrive") == F.col("latest_arrive"), F.concat(F.lit("全區到站時間集中在 "), "earliest_arrive")).otherwise(
        F.concat(F.lit("全區到站時間最早 "), "earliest_arrive", F.lit(",最晚 "), "latest_arrive")
    )
    peak = F.array_max("hour_counts")
    hours = F.filter(F.sequence(F.lit(0), F.lit(23)), lambda h: F.get("hour_counts", h) == peak)
    peak_text = F.when(
        (peak > 1) & (F.size(hours) <= 3),
        F.concat(F.lit(",收運時段以 "), F.array_join(F.transform(hours, lambda h: F.concat(h.cast("string"), F.lit("時"))), "、"), F.lit(" 最為集中(共 "), peak.cast("string"), F.lit(" 筆班次)")),
    ).otherwise("")
    note = P.fill(P.choose(P.DISTRICT_NOTE, rolling_hash(F.col(seed))), {"district": F.col(name), "points": _s("point_count"), "villages": _s("village_count")})
    return s.select(
        *keys,
        "weekday_text",
        F.when(F.size(caveats) > 0, F.concat(F.array_join(caveats, ";"), F.lit("。"))).alias("caveat"),
        F.when(F.col("earliest_arrive").isNotNull(), F.concat(span, peak_text, F.lit("。"))).alias("time_text"),
        note.alias("note"),
    )


# -- points -------------------------------------------------------------------------


def _known_days(entries: str) -> Column:
    return F.sort_array(F.array_distinct(F.flatten(F.transform(entries, lambda e: e["weekday"]))))


def _varied(entries: str) -> Column:
    return F.size(F.array_distinct(F.transform(entries, lambda e: F.struct(e["arrive"], e["depart"])))) > 1


def _arrival(entry: Column) -> Column:
    return F.when(entry["depart"].isNull(), F.concat(F.lit("到站時間約 "), entry["arrive"])).otherwise(
        F.concat(F.lit("到站時間約在 "), entry["arrive"], F.lit("〜"), entry["depart"], F.lit(" 之間"))
    )


def point_summary(points: DataFrame, passing: Column, seed: str = "point_id") -> DataFrame:
    """Shape class of every point and its introduction sentence.

    The schedule that leads is garbage, else recycling, else food scraps. The shape says whether
    its days are known, its times vary, the truck only passes, and the collection type is known.
    """
    has = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    lead = F.when(has("schedule"), F.col("schedule")).when(has("recycling_schedule"), F.col("recycling_schedule")).otherwise(F.col("foodscraps_schedule"))
    df = (
        points.withColumn("lead", lead)
        .withColumn("days", _known_days("lead"))
        .withColumn("first", F.get("lead", F.lit(0)))
        .withColumn("varied", _varied("lead"))
        .withColumn("passing", F.coalesce(passing, F.lit(False)))
        .withColumn("seed", rolling_hash(F.col(seed)))
    )
    unknown = F.size("days") == 0
    other = F.when(unknown, "other_unknown").when(F.col("varied"), "other_varied").otherwise("other_fixed")
    garbage = (
        F.when(unknown, "unknown").when(F.col("varied"), "varied").when(F.col("passing"), "passing").when(F.col("collection_type").isNotNull(), "typed").otherwise("untyped")
    )
    df = df.withColumn("shape", F.when(F.col("first").isNull(), "no_times").when(has("schedule"), garbage).otherwise(other))
    template = None
    for shape, texts in P.INTRO.items():
        text = P.choose(texts, F.col("seed"))
        template = F.when(F.col("shape") == shape, text) if template is None else template.when(F.col("shape") == shape, text)
    first = F.col("first")
    moment = time_text(first["arrive"], first["depart"], F.lit(True))
    values = {
        "where": F.coalesce("address", "point_name"),
        "area": F.concat("district", F.coalesce("village", F.lit(""))),
        "spot": F.coalesce("village", "district"),
        "name": F.col("point_name"),
        "district": F.col("district"),
        "service": F.when(has("recycling_schedule"), "資源回收收運").otherwise("廚餘回收"),
        "days": weekday_list(F.col("days")),
        "time": time_text(first["arrive"], first["depart"], F.col("passing")),
        "arrival": F.when(F.col("passing") & (F.col("shape") == "unknown"), moment).otherwise(_arrival(first)),
    }
    return df.withColumn("summary", P.fill(template, values)).drop("lead", "first", "seed")


def day_sentence(status: DataFrame, passing: Column, seed: str = "point_id") -> DataFrame:
    """Sentence for each row of ``service.day_status``."""
    df = status.withColumn("seed", rolling_hash(F.col(seed)))
    is_passing = F.coalesce(passing, F.lit(False))
    today = F.col("status") == "service_today"
    shape = (
        F.when(~today, F.col("status"))
        .when(is_passing, "passing")
        .when(F.col("hit.depart").isNotNull(), "window")
        .when(F.col("collection_type").isNotNull(), "arrive_typed")
        .otherwise("arrive_untyped")
    )
    df = df.withColumn("shape", shape)
    template = None
    for name, (offset, texts) in P.DAY.items():
        text = P.choose(texts, F.col("seed") + offset)
        template = F.when(F.col("shape") == name, text) if template is None else template.when(F.col("shape") == name, text)
    arrive, depart = F.col("hit.arrive"), F.col("hit.depart")
    moment = F.when(depart.isNull() | (arrive == depart), F.concat(F.lit("約 "), arrive)).otherwise(F.concat(F.lit("約 "), arrive, F.lit("〜"), depart))
    values = {
        "name": F.coalesce("point_name", F.lit("這個清運點")),
        "today": weekday_name(F.col("today")),
        "days": weekday_list(F.col("known_days")),
        "moment": moment,
        "arrive": arrive,
        "depart": depart,
    }
    return df.withColumn("sentence", P.fill(template, values)).drop("seed")


def point_faq(points: DataFrame, headings: DataFrame, id_col: str = "ord", seed: str = "point_id") -> DataFrame:
    """Question rows of every point; ``headings`` gives the neighbour heading per point."""
    df = points.join(headings.select(id_col, "heading"), id_col).withColumn("seed", rolling_hash(F.col(seed)))
    values = {"name": F.col("point_name"), "heading": F.col("heading"), "district": F.col("district"), "city": F.col("city")}
    items = F.array(
        *[F.struct(F.lit(q).alias("question"), P.fill(P.choose(answers, F.col("seed") + i), values).alias("answer")) for i, (q, answers) in enumerate(P.POINT_FAQ)]
    )
    return df.select(id_col, F.posexplode(items).alias("pos", "item")).select(id_col, (F.col("pos") + 1).alias("position"), "item.question", "item.answer")


def unknown_weekday_notice(points: DataFrame, systems: DataFrame, label: str = "收運", id_col: str = "ord") -> DataFrame:
    """Notice for points whose weekdays are unknown: names the city's own query system (city, name), else a general one."""
    named = points.join(systems.select("city", F.col("name").alias("__system")), "city", "left")
    return named.select(id_col, P.fill(F.lit(P.UNKNOWN_NOTICE), {"label": F.lit(label), "system": F.coalesce("__system", F.lit(P.GENERAL_SYSTEM))}).alias("notice"))


# -- structured documents ----------------------------------------------------------


def _typed(kind: str, *fields: Column) -> Column:
    return F.struct(F.lit("https://schema.org").alias("@context"), F.lit(kind).alias("@type"), *fields)


def place_doc(url: Column) -> Column:
    """Place document; NULL without valid coordinates."""
    geo = F.struct(F.lit("GeoCoordinates").alias("@type"), F.col("lat").alias("latitude"), F.col("lng").alias("longitude"))
    doc = F.to_json(_typed("Place", F.col("point_name").alias("name"), F.col("address"), geo.alias("geo"), url.alias("url")))
    return F.when(valid_geo(F.col("lat"), F.col("lng")), doc)


def breadcrumb_doc(items: list[tuple[Column, Column]]) -> Column:
    """Breadcrumb document of (name, url) pairs."""
    elements = F.array(
        *[
            F.struct(F.lit("ListItem").alias("@type"), F.lit(i).alias("position"), name.alias("name"), url.alias("item"))
            for i, (name, url) in enumerate(items, 1)
        ]
    )
    return F.to_json(_typed("BreadcrumbList", elements.alias("itemListElement")))


def faq_docs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One FAQ document per key from question rows (position, question, answer); a handful of rows per key by construction."""
    item = F.struct(
        F.lit("Question").alias("@type"),
        F.col("question").alias("name"),
        F.struct(F.lit("Answer").alias("@type"), F.col("answer").alias("text")).alias("acceptedAnswer"),
    )
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("position", item.alias("item")))), lambda x: x["item"])
    return rows.groupBy(*keys).agg(F.to_json(_typed("FAQPage", ordered.alias("mainEntity"))).alias("doc"))

"""Queries of the lunar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.bindings import SOLAR_TERMS
from schedlake.functions.dates import folk_month
from schedlake.functions.text import map_value
from schedlake.operators import lunar as L
from schedlake.oracle_views import SOLAR_TERMS_SQL
from schedlake.plans.calendars import text_dates
from schedlake.plans.registry import query


def years(v):
    """First and last year of the order dates."""
    span = v.table("orders").agg(F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi"))
    return span.select("lo").scalar(), span.select("hi").scalar()


DATES_CTE = """
WITH yr AS (SELECT CAST(min(year(o_orderdate)) AS INT) AS lo, CAST(max(year(o_orderdate)) AS INT) AS hi FROM orders),
md AS (SELECT DISTINCT lunar_month, lunar_day FROM v_occasions), ky AS (SELECT lunar_month, lunar_day, CAST(unnest(generate_series(lo, hi)) AS INT) AS solar_year FROM md, yr),
rg AS (SELECT lunar_month, lunar_day, CAST(year(solar_date) AS INT) AS solar_year, solar_date, lunar_month_label || lunar_day_label AS lunar_label FROM v_lunar WHERE NOT is_leap_month),
dt AS (SELECT k.*, solar_date, lunar_label, FALSE AS adjusted FROM ky k JOIN rg USING (lunar_month, lunar_day, solar_year)
  UNION ALL SELECT k.*, r.solar_date, r.lunar_label, TRUE FROM ky k JOIN rg r ON r.lunar_month = k.lunar_month AND r.lunar_day = 29 AND r.solar_year = k.solar_year
  WHERE k.lunar_day = 30 AND NOT EXISTS (SELECT 1 FROM rg x WHERE x.lunar_month = k.lunar_month AND x.lunar_day = 30 AND x.solar_year = k.solar_year))
"""


def dates(v):
    return L.occasion_dates(v.occasions(), v.lunar_days(), *years(v))


@query("occasion_dates", "v_occasions v_lunar", sql=DATES_CTE + """
SELECT o.ord, o.deity_name, CAST(solar_date AS VARCHAR) AS solar_date, solar_year, lunar_label, '星期' || ['一', '二', '三', '四', '五', '六', '日'][isodow(solar_date)] AS weekday, adjusted,
  CASE WHEN adjusted THEN solar_year || ' 年農曆' || o.lunar_month || '月僅 29 日,以' || o.lunar_month || '月廿九為準' ELSE '' END AS adjust_note
FROM v_occasions o JOIN dt USING (lunar_month, lunar_day)""")
def occasion_dates(v):
    return text_dates(dates(v).select("ord", "deity_name", "solar_date", "solar_year", "lunar_label", "weekday", "adjusted", "adjust_note"), "solar_date")


@query("occasion_exceptions", "v_occasions v_lunar", sql=DATES_CTE + """,
c AS (SELECT k.*, count(solar_date) AS n, coalesce(bool_or(adjusted), FALSE) AS adjusted FROM ky k LEFT JOIN dt USING (lunar_month, lunar_day, solar_year) GROUP BY 1, 2, 3)
SELECT lunar_month, lunar_day, solar_year, 'type_29_30' AS type, n FROM c WHERE adjusted
UNION ALL SELECT lunar_month, lunar_day, solar_year, CASE WHEN lunar_month >= 10 THEN 'type_year_boundary' ELSE 'unexpected' END, n FROM c WHERE n <> 1""")
def occasion_exceptions(v):
    return L.exceptions(v.occasions(), v.lunar_days(), *years(v))


@query("asof_prev_next", "v_occasions v_lunar", sql=DATES_CTE + """
SELECT k.lunar_month, k.lunar_day, k.solar_year, CAST((SELECT max(solar_date) FROM rg r WHERE r.lunar_month = k.lunar_month AND r.lunar_day = k.lunar_day AND r.solar_year < k.solar_year) AS VARCHAR) AS previous,
  CAST((SELECT min(solar_date) FROM rg r WHERE r.lunar_month = k.lunar_month AND r.lunar_day = k.lunar_day AND r.solar_year > k.solar_year) AS VARCHAR) AS next
FROM ky k WHERE NOT EXISTS (SELECT 1 FROM rg r WHERE r.lunar_month = k.lunar_month AND r.lunar_day = k.lunar_day AND r.solar_year = k.solar_year)""")
def asof_prev_next(v):
    return text_dates(L.around_missing(v.occasions(), v.lunar_days(), *years(v)), "previous", "next")


FESTIVAL_SQL = """
fx(m, d, festival) AS (VALUES (1, 1, '正月初一'), (1, 2, '正月初二'), (1, 3, '正月初三'), (1, 4, '正月初四'), (1, 5, '正月初五'), (1, 15, '元宵'), (5, 5, '端午'), (7, 7, '七夕'), (7, 15, '中元'), (8, 15, '中秋'), (9, 9, '重陽')),
fs AS (SELECT lunar_year, festival, solar_date FROM v_lunar JOIN fx ON m = lunar_month AND d = lunar_day WHERE NOT is_leap_month
  UNION ALL SELECT lunar_year - 1, '除夕', solar_date - 1 FROM v_lunar WHERE NOT is_leap_month AND lunar_month = 1 AND lunar_day = 1
  UNION ALL SELECT lunar_year, solar_term, max(solar_date) FROM v_lunar WHERE solar_term IN ('清明', '冬至') GROUP BY 1, 2)"""


@query("festival_table", "v_lunar", sql="WITH " + FESTIVAL_SQL.strip() + " SELECT CAST(lunar_year AS INT) AS lunar_year, festival, CAST(solar_date AS VARCHAR) AS solar_date, CAST(year(solar_date) AS INT) AS solar_year FROM fs")
def festival_table(v):
    return text_dates(L.festivals(v.lunar_days()), "solar_date")


@query("lunar_lookup", "v_asof v_lunar", sql="""
WITH a AS (SELECT as_of, count(*) AS n_rows FROM v_asof GROUP BY 1)
SELECT CAST(as_of AS VARCHAR) AS as_of, n_rows, lunar_month, lunar_day, is_leap_month, lunar_month_label, lunar_day_label FROM a LEFT JOIN v_lunar ON solar_date = as_of""")
def lunar_lookup(v):
    out = L.to_lunar(v.asof_dates(), "as_of", v.lunar_days())
    return text_dates(out.select("as_of", "n_rows", "lunar_month", "lunar_day", "is_leap_month", "lunar_month_label", "lunar_day_label"), "as_of")


@query("lunar_to_solar", "v_occasions v_lunar", sql="""
WITH q AS (SELECT ord, CAST(CASE WHEN ord % 4 = 0 THEN 6 ELSE lunar_month END AS INT) AS m, lunar_day AS d, ord % 4 = 0 AS leap FROM v_occasions),
y AS (SELECT ord, m, d, leap, CAST(unnest(generate_series(lo, hi)) AS INT) AS lunar_year FROM q, (SELECT min(lunar_year) AS lo, max(lunar_year) AS hi FROM v_lunar))
SELECT ord, y.lunar_year, CAST(solar_date AS VARCHAR) AS solar_date, solar_date IS NULL AS not_exist
FROM y LEFT JOIN v_lunar l ON l.lunar_year = y.lunar_year AND lunar_month = m AND lunar_day = d AND is_leap_month = leap""")
def lunar_to_solar(v):
    signed = F.when(F.col("ord") % 4 == 0, F.lit(-6)).otherwise(F.col("lunar_month"))
    month, leap = L.signed_month(signed)
    asked = v.occasions().select("ord", month.alias("lunar_month"), "lunar_day", leap.alias("is_leap_month"))
    lunar = v.lunar_days()
    span = lunar.agg(F.min("lunar_year").alias("lo"), F.max("lunar_year").alias("hi"))
    out = L.to_solar(asked, lunar, span.select("lo").scalar(), span.select("hi").scalar())
    return text_dates(out.select("ord", "lunar_year", "solar_date", "not_exist"), "solar_date")


SEGMENT_SQL = """
sg AS (SELECT lunar_year, lunar_month, is_leap_month, min(solar_date) AS start, any_value(ganzhi) AS year_name, any_value(lunar_month_label) AS month_label, arg_min(lunar_day, solar_date) AS first_day, CAST(count(*) AS INT) AS days
  FROM v_lunar GROUP BY 1, 2, 3)"""


@query("segment_compress", "v_lunar", sql="WITH " + SEGMENT_SQL.strip() + " SELECT CAST(start AS VARCHAR) AS start, lunar_year, lunar_month, is_leap_month, year_name, month_label, first_day, days FROM sg")
def segment_compress(v):
    return text_dates(L.segments(v.lunar_days()), "start")


@query("interval_lookup", "v_asof v_lunar", sql="WITH " + SEGMENT_SQL.strip() + """,
a AS (SELECT as_of, count(*) AS n_rows FROM v_asof GROUP BY 1)
SELECT CAST(a.as_of AS VARCHAR) AS as_of, n_rows, CAST(datediff('day', start, a.as_of) AS INT) AS "offset", '今天農曆:' || year_name || '年' || month_label || lunar_day_label AS line
FROM a JOIN sg ON a.as_of >= start AND a.as_of < start + days JOIN v_lunar l ON l.solar_date = a.as_of""")
def interval_lookup(v):
    return text_dates(L.segment_lookup(v.asof_dates(), "as_of", L.segments(v.lunar_days())), "as_of")


@query("lunar_year_summary", "v_lunar", sql="""
SELECT lunar_year, count(*) AS days, count(DISTINCT (lunar_month, is_leap_month)) AS months, CAST(max(CASE WHEN is_leap_month THEN lunar_month ELSE 0 END) AS INT) AS leap_month, CAST(min(solar_date) AS VARCHAR) AS start, CAST(max(solar_date) AS VARCHAR) AS "end",
  CAST(min(solar_date) FILTER (WHERE is_leap_month) AS VARCHAR) AS leap_start, CAST(max(solar_date) FILTER (WHERE is_leap_month) AS VARCHAR) AS leap_end FROM v_lunar GROUP BY 1""")
def lunar_year_summary(v):
    return text_dates(L.year_summary(v.lunar_days()), "start", "end", "leap_start", "leap_end")


@query("lunar_checks", "v_lunar", sql="WITH " + FESTIVAL_SQL.strip() + "," + SEGMENT_SQL + f""",
e AS (SELECT min(solar_date) AS lo, max(solar_date) AS hi FROM v_lunar),
y AS (SELECT year(solar_date) AS y, count(*) AS days, count(*) FILTER (WHERE solar_term <> '') AS terms FROM v_lunar GROUP BY 1)
SELECT 'days_complete' AS "check", count(*) = datediff('day', min(solar_date), max(solar_date)) + 1 AND count(DISTINCT solar_date) = count(*) AS passed, count(*) AS observed FROM v_lunar
UNION ALL SELECT 'month_length', count(*) = 0, count(*) FROM sg, e WHERE start <> lo AND start + (days - 1) <> hi AND days NOT IN (29, 30)
UNION ALL SELECT 'terms_per_year', count(*) = 0, count(*) FROM y WHERE days >= 365 AND terms <> 24
UNION ALL SELECT 'term_names', list_sort(list(DISTINCT solar_term)) = list_sort({SOLAR_TERMS_SQL}), count(DISTINCT solar_term) FROM v_lunar WHERE solar_term <> ''
UNION ALL SELECT 'zodiac_names', bool_and(zodiac IN ('鼠', '牛', '虎', '兔', '龍', '蛇', '馬', '羊', '猴', '雞', '狗', '豬')), count(DISTINCT zodiac) FROM v_lunar
UNION ALL SELECT 'leap_years', list_sort(list(DISTINCT lunar_year)) = [1996, 1999, 2002], count(DISTINCT lunar_year) FROM v_lunar WHERE is_leap_month
UNION ALL SELECT 'eve_before_new_year', count(*) = 0, count(*) FROM fs n LEFT JOIN fs v ON v.festival = '除夕' AND v.lunar_year = n.lunar_year - 1 WHERE n.festival = '正月初一' AND (v.solar_date IS NULL OR v.solar_date + 1 <> n.solar_date)""")
def lunar_checks(v):
    return L.checks(v.lunar_days(), [1996, 1999, 2002], SOLAR_TERMS)


@query("upcoming", "v_asof v_occasions v_lunar", sql=DATES_CTE + """,
ev AS (SELECT o.ord, o.deity_name, solar_date FROM v_occasions o JOIN dt USING (lunar_month, lunar_day)),
pd AS (SELECT *, row_number() OVER (ORDER BY solar_date, ord) AS pos FROM ev),
a AS (SELECT as_of, count(*) AS n_rows FROM v_asof GROUP BY 1), f AS (SELECT a.as_of, n_rows, (SELECT min(pos) FROM pd WHERE solar_date >= as_of) AS p0 FROM a)
SELECT CAST(as_of AS VARCHAR) AS as_of, n_rows, CAST(pos - p0 + 1 AS INT) AS rank, CAST(solar_date AS VARCHAR) AS solar_date, ord, deity_name FROM f JOIN pd ON pos BETWEEN p0 AND p0 + 2""")
def upcoming(v):
    events = dates(v).select("solar_date", "ord", "deity_name")
    return text_dates(L.upcoming(v.asof_dates(), "as_of", events, "solar_date", "ord", 3), "as_of", "solar_date")


@query("nested_documents", "v_occasions v_lunar", sql=DATES_CTE + """,
k AS (SELECT deity_name, lunar_month, lunar_day, occasion_type, arg_min(common_name, ord) AS common_name, nullif(arg_min(honorific_source, ord), occasion_type) AS honorific FROM v_occasions GROUP BY 1, 2, 3, 4),
d AS (SELECT lunar_month, lunar_day, count(*) AS n, min(solar_date) AS first, max(solar_date) AS last FROM dt GROUP BY 1, 2)
SELECT deity_name, min(common_name) AS common_name, count(*) AS n_occasions, coalesce(sum(n), 0)::BIGINT AS n_dates, CAST(min(first) AS VARCHAR) AS first_date, CAST(max(last) AS VARCHAR) AS last_date,
  string_agg(lunar_month || '/' || lunar_day || ':' || occasion_type || ':' || coalesce(honorific, '-'), '|' ORDER BY lunar_month, lunar_day, occasion_type) AS shape
FROM k LEFT JOIN d USING (lunar_month, lunar_day) GROUP BY 1""")
def nested_documents(v):
    docs = L.documents(v.occasions(), dates(v))
    o = F.col("occasions")
    ends = F.flatten(F.transform(o, lambda x: F.transform(F.coalesce(x["dates"], F.array()), lambda d: d["solar_date"])))
    shape = F.array_join(
        F.transform(
            F.sort_array(F.transform(o, lambda x: F.struct(x["lunar_month"].alias("m"), x["lunar_day"].alias("d"), x["occasion_type"].alias("t"), F.coalesce(x["honorific"], F.lit("-")).alias("h")))),
            lambda x: F.concat(x["m"].cast("string"), F.lit("/"), x["d"].cast("string"), F.lit(":"), x["t"], F.lit(":"), x["h"]),
        ),
        "|",
    )
    out = docs.select(
        "deity_name", "common_name", F.size(o).cast("long").alias("n_occasions"), F.size(ends).cast("long").alias("n_dates"),
        F.array_min(ends).alias("first_date"), F.array_max(ends).alias("last_date"), shape.alias("shape"),
    )
    return text_dates(out, "first_date", "last_date")


@query("document_rows", "v_occasions v_lunar", sql=DATES_CTE + """,
k AS (SELECT deity_name, lunar_month, lunar_day, occasion_type, nullif(arg_min(honorific_source, ord), occasion_type) AS honorific FROM v_occasions GROUP BY 1, 2, 3, 4)
SELECT k.deity_name, k.lunar_month, k.lunar_day, k.occasion_type, honorific, 'https://example.org/' || lower(replace(k.deity_name, '#', '-')) AS url, 'Example' AS source_name,
  CASE WHEN k.lunar_day = 15 THEN 'full moon' END AS note,
  CASE WHEN k.lunar_day = 30 AND k.lunar_month % 2 = 0 AND (SELECT bool_or(adjusted) FROM dt d WHERE d.lunar_month = k.lunar_month AND d.lunar_day = k.lunar_day) THEN 'rule ' || k.lunar_month END AS substitution,
  CAST(solar_date AS VARCHAR) AS solar_date, solar_year, '星期' || ['一', '二', '三', '四', '五', '六', '日'][isodow(solar_date)] AS weekday, adjusted,
  CASE WHEN adjusted THEN solar_year || ' 年農曆' || k.lunar_month || '月僅 29 日,以' || k.lunar_month || '月廿九為準' ELSE '' END AS adjust_note
FROM k JOIN dt USING (lunar_month, lunar_day)""")
def document_rows(v):
    """The whole documents, sources, notes, rules and dates included, as one row per date."""
    occasions = v.occasions().withColumn("source_1", F.concat(F.lit("https://example.org/"), F.lower(F.replace("deity_name", F.lit("#"), F.lit("-")))))
    key = occasions.select("deity_name", "lunar_month", "lunar_day", "occasion_type").distinct()
    notes = key.filter("lunar_day = 15").withColumn("note", F.lit("full moon"))
    rules = key.filter("lunar_day = 30 AND lunar_month % 2 = 0").select("deity_name", "lunar_month", "lunar_day").distinct().withColumn("substitution", F.concat(F.lit("rule "), "lunar_month"))
    docs = L.documents(occasions, dates(v), notes=notes, substitutions=rules, hosts={"example.org": "Example"})
    each = docs.select("deity_name", F.inline("occasions")).select(
        "deity_name", "lunar_month", "lunar_day", "occasion_type", "honorific", F.col("sources")[0]["url"].alias("url"), F.col("sources")[0]["name"].alias("source_name"),
        "note", F.col("thirty_day_substitution").alias("substitution"), F.inline("dates"),
    )
    return text_dates(each, "solar_date")


@query("document_problems", "v_occasions v_lunar", sql=DATES_CTE + """,
k AS (SELECT DISTINCT deity_name, lunar_month, lunar_day, occasion_type FROM v_occasions),
d AS (SELECT lunar_month, lunar_day, bool_or(adjusted) AS moved FROM dt GROUP BY 1, 2)
SELECT deity_name, k.lunar_month, k.lunar_day, CASE WHEN d.moved IS NULL THEN 'no_dates' ELSE 'substitution_without_source' END AS problem
FROM k LEFT JOIN d ON d.lunar_month = k.lunar_month AND d.lunar_day = k.lunar_day WHERE d.moved IS NULL OR (d.moved AND k.lunar_month % 2 = 1)
UNION ALL SELECT 'nobody', 1, 30, 'stale_substitution'""")
def document_problems(v):
    key = v.occasions().filter("lunar_day = 30 AND lunar_month % 2 = 0").select("deity_name", "lunar_month", "lunar_day").distinct()
    rules = key.unionByName(v.spark.createDataFrame([("nobody", 1, 30)], "deity_name string, lunar_month int, lunar_day int")).withColumn("substitution", F.lit("rule"))
    return L.document_problems(L.documents(v.occasions(), dates(v), substitutions=rules), rules)


@query("label_rewrite", "v_lunar v_asof", sql="""
WITH a AS (SELECT as_of, count(*) AS n FROM v_asof GROUP BY 1), l AS (SELECT lunar_month_label || lunar_day_label AS label, solar_term AS term, n FROM v_lunar JOIN a ON as_of = solar_date)
SELECT label, CASE WHEN label LIKE '十二月%' THEN '臘月' || substr(label, 4) WHEN label LIKE '一月%' THEN '正月' || substr(label, 3) ELSE label END AS folk, term, sum(n)::BIGINT AS n FROM l GROUP BY ALL""")
def label_rewrite(v):
    asked = v.asof_dates().groupBy(F.col("as_of").alias("solar_date")).agg(F.count(F.lit(1)).alias("n"))
    simplified = map_value(F.col("solar_term"), {t: s for s, t in L.TERM_FORMS.items()}, F.col("solar_term"))
    rows = v.lunar_days().withColumn("simple", simplified).join(asked, "solar_date")
    label = F.concat("lunar_month_label", "lunar_day_label")
    return rows.groupBy(label.alias("label"), folk_month(label).alias("folk"), map_value(F.col("simple"), L.TERM_FORMS, F.col("simple")).alias("term")).agg(F.sum("n").alias("n"))

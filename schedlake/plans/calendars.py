"""Queries of the calendar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from schedlake.operators import calendar as C
from schedlake.operators import foreign as X
from schedlake.operators import publish as P
from schedlake.plans.registry import query

HEADS = ["H1", "H3", "H5", "H9", "H12"]
LABELS = {"H3": "third"}
COUNTRIES = ["jp", "sg"]


def text_dates(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.col(c).cast("string"))
    return df


def lw_sql(view: str, prefix: str = "lw") -> str:
    return f"""
{prefix}_r AS (SELECT *, d - CAST(row_number() OVER (PARTITION BY year(d) ORDER BY d) AS INT) AS run FROM {view} WHERE is_holiday),
{prefix} AS (SELECT CAST(year(d) AS INT) AS year, min(d) AS start, max(d) AS "end", CAST(count(*) AS INT) AS days,
  coalesce(list(memo ORDER BY d) FILTER (WHERE memo <> ''), []) AS names FROM {prefix}_r GROUP BY year(d), run HAVING count(*) >= 3),
{prefix}_t AS (SELECT *, [CASE WHEN n = 'H3' THEN 'third' ELSE n END FOR n IN names IF n IN ('H1', 'H3', 'H5', 'H9', 'H12')] AS heads FROM {prefix})"""


HEAD_TEXT = "array_to_string([h FOR h, i IN heads IF list_position(heads, h) = i], '・')"


def weekends(v, gaps=False):
    return C.titled(C.long_weekends(v.calendar(gaps)), HEADS, LABELS)


def weekend_rows(v, gaps):
    out = weekends(v, gaps).withColumn("names", F.array_join("names", ","))
    return text_dates(out, "start", "end").orderBy("start")


WEEKEND_SELECT = f"""
SELECT year, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", days, array_to_string(names, ',') AS names,
  CASE WHEN len(heads) > 0 THEN {HEAD_TEXT} || '連假' ELSE '連假(' || CAST(start AS VARCHAR) || ' 起 ' || CAST(days AS VARCHAR) || ' 天)' END AS title, strftime(start, '%m%d') AS slug
FROM lw_t"""


@query("long_weekends", "v_calendar", sql="WITH " + lw_sql("v_calendar").strip() + WEEKEND_SELECT)
def long_weekends(v):
    return weekend_rows(v, False)


@query("long_weekends_gaps", "v_calendar_gaps", sql="WITH " + lw_sql("v_calendar_gaps").strip() + WEEKEND_SELECT)
def long_weekends_gaps(v):
    return weekend_rows(v, True)


def block_sql(view: str) -> str:
    return f"""
rows_ AS (SELECT *, row_number() OVER (PARTITION BY year(d) ORDER BY d) AS rn, row_number() OVER (PARTITION BY year(d) ORDER BY d) - row_number() OVER (PARTITION BY year(d), is_holiday ORDER BY d) AS blk FROM {view}),
b AS (SELECT CAST(year(d) AS INT) AS year, blk, min(d) AS start, max(d) AS "end", min(rn) AS rn0, max(rn) AS rn1, coalesce(list(memo ORDER BY d) FILTER (WHERE memo <> '' AND memo <> '補假'), []) AS named
  FROM rows_ WHERE is_holiday GROUP BY year(d), blk)"""


BLOCK_SELECT = """
SELECT year, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", CAST(rn1 - rn0 + 1 AS INT) AS rows, array_to_string(named, ',') AS named FROM b"""


def block_rows(v, gaps):
    return text_dates(C.holiday_blocks(v.calendar(gaps)).withColumn("named", F.array_join("named", ",")), "start", "end")


@query("holiday_blocks", "v_calendar", sql="WITH " + block_sql("v_calendar").strip() + BLOCK_SELECT)
def holiday_blocks(v):
    return block_rows(v, False)


@query("holiday_blocks_gaps", "v_calendar_gaps", sql="WITH " + block_sql("v_calendar_gaps").strip() + BLOCK_SELECT)
def holiday_blocks_gaps(v):
    return block_rows(v, True)


PLAN_SELECT = """,
n AS (SELECT *, lag("end") OVER w AS pe, lag(start) OVER w AS ps, lag(rn1) OVER w AS prn1, lead(start) OVER w AS ns, lead("end") OVER w AS ne, lead(rn0) OVER w AS nrn0 FROM b WINDOW w AS (PARTITION BY year ORDER BY start)),
g AS (SELECT *, coalesce(rn0 - prn1 - 1 BETWEEN 1 AND 3, FALSE) AS l, coalesce(nrn0 - rn1 - 1 BETWEEN 1 AND 3, FALSE) AS r FROM n),
p AS (SELECT g.year, g.start AS bs, CASE WHEN l THEN ps ELSE g.start END AS start, CASE WHEN r THEN ne ELSE g."end" END AS "end", named,
  list(c.d ORDER BY c.d) AS leave FROM g JOIN rows_ c ON year(c.d) = g.year AND ((l AND c.d > pe AND c.d < g.start) OR (r AND c.d > g."end" AND c.d < ns))
  WHERE len(named) > 0 AND (l OR r) GROUP BY ALL),
q AS (SELECT *, [n FOR n, i IN named IF list_position(named, n) = i] AS anchors FROM p),
h AS (SELECT *, [CASE WHEN n = 'H3' THEN 'third' ELSE n END FOR n IN anchors IF n IN ('H1', 'H3', 'H5', 'H9', 'H12')] AS heads FROM q)
SELECT year, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", CAST(datediff('day', start, "end") + 1 AS INT) AS total_days, array_to_string([CAST(x AS VARCHAR) FOR x IN leave], ',') AS leave_dates,
  array_to_string(anchors, ',') AS anchor_names, CASE WHEN len(heads) > 0 THEN array_to_string(heads, '・') ELSE array_to_string([CASE WHEN n = 'H3' THEN 'third' ELSE n END FOR n IN anchors], '・') END || '拼假攻略' AS title,
  '請 ' || len(leave) || ' 天特休(' || array_to_string([CAST(x AS VARCHAR) FOR x IN leave], '、') || '),可連休 ' || (datediff('day', start, "end") + 1) || ' 天(' || CAST(start AS VARCHAR) || ' ~ ' || CAST("end" AS VARCHAR) || ')。' AS sentence
FROM h"""


def plan_rows(v, gaps):
    out = C.described(C.leave_plans(v.calendar(gaps)), HEADS, LABELS)
    out = out.withColumn("leave_dates", F.array_join(F.col("leave_dates").cast("array<string>"), ",")).withColumn("anchor_names", F.array_join("anchor_names", ","))
    return text_dates(out, "start", "end")


@query("leave_plans", "v_calendar", sql="WITH " + block_sql("v_calendar").strip() + PLAN_SELECT)
def leave_plans(v):
    return plan_rows(v, False)


@query("leave_plans_gaps", "v_calendar_gaps", sql="WITH " + block_sql("v_calendar_gaps").strip() + PLAN_SELECT)
def leave_plans_gaps(v):
    return plan_rows(v, True)


@query("calendar_totals", "v_calendar", sql="""
SELECT CAST(year(d) AS INT) AS year, count(*) AS total_days, count(*) FILTER (WHERE is_holiday) AS holiday_days, count(*) FILTER (WHERE memo = '補假') AS makeup_holidays,
  count(*) FILTER (WHERE weekday >= 6 AND NOT is_holiday) AS makeup_workdays FROM v_calendar GROUP BY 1""")
def calendar_totals(v):
    return C.totals(v.calendar())


@query("next_holiday", "v_calendar v_asof", sql="WITH " + lw_sql("v_calendar").strip() + f""",
tt AS (SELECT *, CASE WHEN len(heads) > 0 THEN {HEAD_TEXT} || '連假' ELSE '連假(' || CAST(start AS VARCHAR) || ' 起 ' || CAST(days AS VARCHAR) || ' 天)' END AS title FROM lw_t),
a AS (SELECT as_of, count(*) AS n_rows FROM v_asof GROUP BY 1),
m AS (SELECT a.*, (SELECT min(start) FROM lw WHERE "end" >= as_of) AS start FROM a)
SELECT CAST(as_of AS VARCHAR) AS as_of, n_rows, CAST(m.start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end", title,
  CASE WHEN m.start IS NULL THEN 'none' WHEN m.start > as_of THEN 'ahead' WHEN m.start = as_of THEN 'first_day' WHEN "end" = as_of THEN 'last_day' ELSE 'running' END AS status,
  CASE WHEN m.start > as_of THEN '下一個連假:' || title || ',還有 ' || datediff('day', as_of, m.start) || ' 天' WHEN m.start = as_of THEN '連假中:' || title || ',今天開始,放到 ' || strftime("end", '%m/%d')
    WHEN "end" = as_of THEN '連假中:' || title || ',今天是最後一天' WHEN m.start IS NOT NULL THEN '連假中:' || title || ',放到 ' || strftime("end", '%m/%d') END AS line
FROM m LEFT JOIN tt ON tt.start = m.start""")
def next_holiday(v):
    found = C.next_interval(v.asof_dates(), "as_of", weekends(v).select("start", "end", "title"))
    return text_dates(C.countdown(found, "as_of"), "as_of", "start", "end").select("as_of", "n_rows", "start", "end", "title", "status", "line")


@query("festival_check", "v_calendar", sql="WITH " + lw_sql("v_calendar").strip() + """,
y AS (SELECT DISTINCT CAST(year(d) AS INT) AS year FROM v_calendar), k AS (SELECT year, unnest(['H3', 'H7', 'H10', 'none']) AS memo FROM y),
f AS (SELECT k.year, k.memo, min(d) AS d FROM k LEFT JOIN v_calendar c ON year(c.d) = k.year AND c.memo = k.memo GROUP BY 1, 2)
SELECT year, CASE WHEN memo = 'H3' THEN 'third' ELSE memo END AS name, CAST(d AS VARCHAR) AS d, coalesce((SELECT bool_or(f.d BETWEEN lw.start AND lw."end") FROM lw), FALSE) AS forms_long_weekend FROM f""")
def festival_check(v):
    return text_dates(C.festival_check(v.calendar(), C.long_weekends(v.calendar()), ["H3", "H7", "H10", "none"], LABELS), "d")


CLOSURE_CTE = """
cl AS (SELECT 'jp' AS country, c.* FROM v_calendar c WHERE (strftime(d, '%m-%d') >= '12-29' OR strftime(d, '%m-%d') <= '01-03') AND d NOT IN (SELECT d FROM v_foreign WHERE country = 'jp'))"""
COMPARE_CTE = "WITH " + lw_sql("v_calendar").strip() + "," + CLOSURE_CTE + """,
sp AS (SELECT year, start, CAST(unnest(generate_series(start, "end", INTERVAL 1 DAY)) AS DATE) AS d FROM lw),
cd AS (SELECT sp.year, sp.start, sp.d, CASE WHEN c.d IS NULL THEN '—' WHEN NOT is_holiday THEN CASE WHEN weekday >= 6 THEN '補班' ELSE '上班' END ELSE coalesce(nullif(memo, ''), '週末') END AS home,
  coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM v_foreign f WHERE f.d = sp.d AND country = 'jp'), '') AS jp_names,
  coalesce((SELECT string_agg(DISTINCT name, ',' ORDER BY name) FROM v_foreign f WHERE f.d = sp.d AND country = 'sg'), '') AS sg_names,
  sp.d IN (SELECT d FROM cl) AS closed FROM sp LEFT JOIN v_calendar c ON c.d = sp.d)"""


def compared(v):
    cal, foreign = v.calendar(), v.foreign()
    closures = X.closure_dates(cal, v.closure_rule(), foreign)
    return C.long_weekends(cal), cal, foreign, closures


@query("compare_days", "v_calendar v_foreign", sql=COMPARE_CTE + """
SELECT year, CAST(start AS VARCHAR) AS start, CAST(d AS VARCHAR) AS d, home, jp_names, sg_names, closed FROM cd""")
def compare_days(v):
    out = X.compare_days(*compared(v), COUNTRIES)
    for c in COUNTRIES:
        out = out.withColumn(f"{c}_names", F.array_join(f"{c}_names", ","))
    return text_dates(out, "start", "d")


@query("compare_weekends", "v_calendar v_foreign", sql=COMPARE_CTE + """
SELECT year, CAST(start AS VARCHAR) AS start, count(*) FILTER (WHERE jp_names <> '') AS jp_days, count(*) FILTER (WHERE sg_names <> '') AS sg_days, count(*) FILTER (WHERE closed) AS closure_days,
  CAST(start AS VARCHAR) || ' 至 ' || CAST(max(d) AS VARCHAR) || '(' || count(*) || ' 天):' || CASE WHEN count(*) FILTER (WHERE jp_names <> '') > 0 THEN '日本有 ' || count(*) FILTER (WHERE jp_names <> '') || ' 天是當地國定假日' ELSE '日本沒有當地國定假日' END || ';'
  || CASE WHEN count(*) FILTER (WHERE sg_names <> '') > 0 THEN '新加坡有 ' || count(*) FILTER (WHERE sg_names <> '') || ' 天是當地國定假日' ELSE '新加坡沒有當地國定假日' END || '。' AS sentence FROM cd GROUP BY year, start""")
def compare_weekends(v):
    parts = compared(v)
    counted = X.per_weekend(X.compare_days(*parts, COUNTRIES), COUNTRIES)
    return text_dates(X.weekend_sentence(counted, parts[0], {"jp": "日本", "sg": "新加坡"}).drop("end", "days"), "start")


@query("workday_holidays", "v_calendar v_foreign", sql="""
SELECT country, CAST(f.d AS VARCHAR) AS d, name, weekday >= 6 AS makeup FROM v_foreign f JOIN v_calendar c ON c.d = f.d WHERE NOT is_holiday""")
def workday_holidays(v):
    return text_dates(X.workday_holidays(v.calendar(), v.foreign()), "d")


@query("closure_days", "v_calendar v_foreign", sql="WITH " + CLOSURE_CTE.strip() + " SELECT country, CAST(d AS VARCHAR) AS d, is_holiday FROM cl")
def closure_days(v):
    return text_dates(compared(v)[3].select("country", "d", "is_holiday"), "d")


@query("compare_year", "v_calendar v_foreign", sql=COMPARE_CTE + """,
pw AS (SELECT year, start, count(*) FILTER (WHERE jp_names <> '') AS jp, count(*) FILTER (WHERE sg_names <> '') AS sg FROM cd GROUP BY 1, 2),
y AS (SELECT DISTINCT CAST(year(d) AS INT) AS year FROM v_calendar),
a AS (SELECT year, count(*) AS long_weekends, count(*) FILTER (WHERE jp > 0) AS jp_weekends, count(*) FILTER (WHERE sg > 0) AS sg_weekends FROM pw GROUP BY 1),
n AS (SELECT year(d) AS year, count(DISTINCT d) FILTER (WHERE country = 'jp') AS jp_national, count(DISTINCT d) FILTER (WHERE country = 'sg') AS sg_national FROM v_foreign GROUP BY 1),
w AS (SELECT year(f.d) AS year, count(*) FILTER (WHERE country = 'jp') AS jp_workday, count(*) FILTER (WHERE country = 'sg') AS sg_workday,
  count(*) FILTER (WHERE country = 'jp' AND weekday >= 6) AS jp_makeup, count(*) FILTER (WHERE country = 'sg' AND weekday >= 6) AS sg_makeup FROM v_foreign f JOIN v_calendar c ON c.d = f.d WHERE NOT is_holiday GROUP BY 1),
k AS (SELECT year(d) AS year, count(*) AS closure_dates, count(*) FILTER (WHERE NOT is_holiday) AS closure_workdays FROM cl GROUP BY 1),
z AS (SELECT y.year, coalesce(long_weekends, 0) AS long_weekends, coalesce(jp_weekends, 0) AS jp_weekends, coalesce(sg_weekends, 0) AS sg_weekends, coalesce(jp_national, 0) AS jp_national, coalesce(sg_national, 0) AS sg_national,
  coalesce(jp_workday, 0) AS jp_workday, coalesce(sg_workday, 0) AS sg_workday, coalesce(jp_makeup, 0) AS jp_makeup, coalesce(sg_makeup, 0) AS sg_makeup, coalesce(closure_dates, 0) AS closure_dates, coalesce(closure_workdays, 0) AS closure_workdays
  FROM y LEFT JOIN a ON a.year = y.year LEFT JOIN n ON n.year = y.year LEFT JOIN w ON w.year = y.year LEFT JOIN k ON k.year = y.year)
SELECT *, year || ' 年台灣有 ' || long_weekends || ' 個 3 天以上連假;其中 ' || jp_weekends || ' 個連假期間日本有當地國定假日,' || sg_weekends || ' 個連假期間新加坡有當地國定假日。' AS summary,
  year || ' 年日本當地國定假日共 ' || jp_national || ' 天,其中 ' || jp_workday || ' 天台灣當天要上班' || CASE WHEN jp_makeup > 0 THEN '(含 ' || jp_makeup || ' 天為台灣週末補班日)' ELSE '' END || '。' AS jp_sentence,
  year || ' 年新加坡當地國定假日共 ' || sg_national || ' 天,其中 ' || sg_workday || ' 天台灣當天要上班' || CASE WHEN sg_makeup > 0 THEN '(含 ' || sg_makeup || ' 天為台灣週末補班日)' ELSE '' END || '。' AS sg_sentence,
  year || ' 年落在 12/29–12/31 與 1/1–1/3 區間、且不是日本國民の祝日的日期共 ' || closure_dates || ' 天,其中 ' || closure_workdays || ' 天台灣當天要上班。' AS closure_sentence FROM z""")
def compare_year(v):
    return X.compare_year(*compared(v), COUNTRIES, {"jp": "日本", "sg": "新加坡"})


@query("holiday_names", sql="""
WITH n AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'New Year’s Day' WHEN 2 THEN 'Good Friday' WHEN 3 THEN 'Deepavali' WHEN 4 THEN 'Local Day' ELSE 'Vesak Day' END || CASE WHEN l_orderkey % 3 = 0 THEN ' (Observed)' ELSE '' END AS name FROM lineitem),
d AS (SELECT name, replace(name, ' (Observed)', '') AS base, count(*) AS n FROM n GROUP BY 1, 2)
SELECT name, coalesce(CASE base WHEN 'New Year’s Day' THEN '元旦' WHEN 'Good Friday' THEN '耶穌受難日' WHEN 'Deepavali' THEN '屠妖節' WHEN 'Vesak Day' THEN '衛塞節' END || CASE WHEN name <> base THEN '補假' ELSE '' END || '(' || name || ')', name) AS display, n FROM d""")
def holiday_names(v):
    name = F.expr(
        "concat(CASE l_linenumber WHEN 1 THEN 'New Year’s Day' WHEN 2 THEN 'Good Friday' WHEN 3 THEN 'Deepavali' WHEN 4 THEN 'Local Day' ELSE 'Vesak Day' END,"
        " CASE WHEN l_orderkey % 3 = 0 THEN ' (Observed)' ELSE '' END)"
    )
    return v.table("lineitem").groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select("name", X.display_name(F.col("name")).alias("display"), "n")


@query("calendar_events", "v_calendar", sql=r"""
SELECT strftime(d, '%Y%m%d') || '@example.org' AS uid, strftime(d, '%Y%m%d') AS dtstart, strftime(d + 1, '%Y%m%d') AS dtend, memo || '\,x\;y\\z' AS summary, 'see calendar\, year ' || year(d) AS description
FROM v_calendar WHERE is_holiday AND memo <> ''""")
def calendar_events(v):
    days = v.calendar().withColumn("memo", F.when(F.col("memo") != "", F.concat("memo", F.lit(",x;y\\z"))))
    return P.calendar_events(days, "example.org", "see calendar, year ")


@query("date_spine", sql="""
SELECT CAST(d AS VARCHAR) AS d, count(*) AS open_orders FROM
  (SELECT CAST(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT), INTERVAL 1 DAY)) AS DATE) AS d FROM orders) GROUP BY 1""")
def date_spine(v):
    start = F.to_date("o_orderdate")
    spans = v.table("orders").select(start.alias("start"), F.date_add(start, (F.col("o_orderkey") % 5).cast("int")).alias("end"))
    return text_dates(C.interval_days(spans).groupBy("d").agg(F.count(F.lit(1)).alias("open_orders")), "d")


@query("spot_checks", "v_calendar", sql="""
WITH e AS (SELECT CAST(year(d) AS INT) AS year, memo, min(d) AS first, max(d) AS last FROM v_calendar WHERE memo <> '' GROUP BY 1, 2),
x AS (SELECT year, memo, first AS expected, TRUE AS positive FROM e UNION ALL SELECT year, memo, last + 1, FALSE FROM e)
SELECT year, memo, CAST(expected AS VARCHAR) AS expected, positive, EXISTS (SELECT 1 FROM v_calendar c WHERE year(c.d) = x.year AND c.memo = x.memo AND c.d = x.expected) AS found,
  EXISTS (SELECT 1 FROM v_calendar c WHERE year(c.d) = x.year AND c.memo = x.memo AND c.d = x.expected) = positive AS ok FROM x""")
def spot_checks(v):
    from schedlake.operators.quality import spot_checks as check

    named = v.calendar().filter("memo <> ''").withColumn("year", F.year("d"))
    e = named.groupBy("year", "memo").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    expected = e.select("year", "memo", F.col("first").alias("expected"), F.lit(True).alias("positive")).unionByName(
        e.select("year", "memo", F.date_add("last", 1).alias("expected"), F.lit(False).alias("positive"))
    )
    return text_dates(check(expected, named, ["year", "memo"], "d"), "expected")

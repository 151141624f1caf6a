"""The views of ``bindings.py`` as DuckDB SQL, for the side-by-side check."""

from __future__ import annotations

from schedlake.bindings import SOLAR_TERMS
from schedlake.functions.dates import DAY_LABELS, MONTH_NAMES
from schedlake.functions.times import WEEKDAY_CHARS


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SOLAR_TERMS_SQL = sql_list(SOLAR_TERMS)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_points": ((), """
SELECT c_custkey AS ord, lower(replace(r_name,' ','')) AS city_slug, r_name AS city, n_name AS district,
  CASE WHEN n_nationkey = 1 THEN 'nation0' ELSE lower(replace(n_name,'_','')) END AS district_slug,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat('V', CAST(c_custkey % 4 AS VARCHAR)) END AS village,
  CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE concat('Road ', CAST(c_custkey % 6 AS VARCHAR)) END AS point_name,
  concat('PL', CAST(c_custkey % 5 AS VARCHAR)) AS plate,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN CAST(10 AS DOUBLE)
       ELSE CAST(21.5 AS DOUBLE) + CAST((c_custkey*37) % 400 AS DOUBLE)/100 END AS lat,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(119.5 AS DOUBLE) + CAST((c_custkey*53) % 300 AS DOUBLE)/100 END AS lng,
  CASE WHEN c_custkey % 2 = 0 THEN 'FIXED' WHEN c_custkey % 3 = 0 THEN 'PASS' ELSE NULL END AS collection_type,
  concat(upper(substr(r_name,1,3)), '-', CASE WHEN n_nationkey = 1 THEN 'NATION0' ELSE upper(replace(n_name,'_','')) END, '-', CAST(c_custkey AS VARCHAR)) AS point_id,
  CASE WHEN c_custkey % 3 = 0 THEN concat('2026-07-', lpad(CAST(c_custkey % 28 + 1 AS VARCHAR),2,'0'))
       ELSE concat('2026-07-', lpad(CAST(c_custkey % 28 + 1 AS VARCHAR),2,'0'), 'T11:50:16.537798+08:00') END AS fetched_at
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "v_entries": ((), """
SELECT o_custkey AS ord, o_orderkey AS seq,
  CASE o_orderstatus WHEN 'O' THEN 'garbage' WHEN 'F' THEN 'recycling' ELSE 'foodscraps' END AS kind,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderkey % 7 + 1 AS INT) END AS weekday,
  concat(lpad(CAST((o_orderkey*7) % 24 AS VARCHAR),2,'0'), ':', lpad(CAST((o_orderkey*11) % 60 AS VARCHAR),2,'0')) AS arrive,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat(lpad(CAST((o_orderkey*7) % 24 AS VARCHAR),2,'0'), ':59') END AS depart
FROM orders"""),
    # one row per merged schedule entry: (point, kind, arrive, depart) with its sorted weekday list
    "v_merged": (("v_entries",), """
SELECT ord, kind, arrive, depart, coalesce(list_sort(list(DISTINCT weekday) FILTER (WHERE weekday IS NOT NULL)), []) AS days
FROM v_entries GROUP BY ord, kind, arrive, depart, weekday IS NULL"""),
    "v_calendar": ((), """
SELECT d, CAST(isodow(d) AS INT) AS weekday,
  (isodow(d) >= 6 OR (month(d)*31 + day(d)) % 29 = 0) AS is_holiday,
  CASE WHEN (month(d)*31 + day(d)) % 29 = 0 THEN concat('H', CAST(month(d) AS VARCHAR)) ELSE '' END AS memo
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) t"""),
    "v_calendar_gaps": (("v_calendar",), """
SELECT * FROM v_calendar WHERE NOT (month(d) % 3 = 0 AND day(d) BETWEEN 8 AND 12 AND NOT is_holiday)"""),
    "v_foreign": ((), """
SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'jp' ELSE 'sg' END AS country,
  CAST(l_shipdate AS DATE) AS d, concat('F', CAST(l_linenumber AS VARCHAR)) AS name
FROM lineitem GROUP BY ALL HAVING sum(l_orderkey) % 23 = 0"""),
    "v_asof": ((), "SELECT CAST(l_shipdate AS DATE) AS as_of, l_orderkey, l_linenumber FROM lineitem"),
    "v_lunar_index": ((), """
SELECT d AS solar_date, datediff('day', lo, d) AS i FROM (
  SELECT lo, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS d
  FROM (SELECT CAST(min(o_orderdate) AS DATE) AS lo, CAST(max(o_orderdate) AS DATE) AS hi FROM orders))"""),
    "v_lunar_month": (("v_lunar_index",), """
SELECT solar_date, q, least(q // 12, 2) AS y, cycle, CAST(CASE WHEN r < 30 THEN r + 1 ELSE r - 29 END AS INT) AS lunar_day FROM (
  SELECT solar_date, i % 59 AS r, (10 + 2*(i // 59) + CASE WHEN i % 59 < 30 THEN 0 ELSE 1 END) % 37 AS q,
    (10 + 2*(i // 59) + CASE WHEN i % 59 < 30 THEN 0 ELSE 1 END) // 37 AS cycle FROM v_lunar_index)"""),
    "v_lunar_base": (("v_lunar_month",), """
SELECT solar_date, CAST(1994 + 3*cycle + y AS INT) AS lunar_year,
  CAST(CASE WHEN y = 2 AND q - 24 >= 6 THEN q - 24 ELSE q - 12*y + 1 END AS INT) AS lunar_month, lunar_day,
  (y = 2 AND q - 24 = 6) AS is_leap_month FROM v_lunar_month"""),
    "v_lunar": (("v_lunar_base",), f"""
SELECT *, (CASE WHEN is_leap_month THEN '閏' ELSE '' END) || {sql_list(MONTH_NAMES)}[lunar_month] || '月' AS lunar_month_label,
  {sql_list(DAY_LABELS)}[lunar_day] AS lunar_day_label,
  {sql_list('甲乙丙丁戊己庚辛壬癸')}[(lunar_year-4) % 10 + 1] || {sql_list('子丑寅卯辰巳午未申酉戌亥')}[(lunar_year-4) % 12 + 1] AS ganzhi,
  {sql_list('鼠牛虎兔龍蛇馬羊猴雞狗豬')}[(lunar_year-4) % 12 + 1] AS zodiac,
  CASE WHEN (dayofyear(solar_date)-5) % 15 = 0 AND dayofyear(solar_date) BETWEEN 5 AND 350
       THEN {SOLAR_TERMS_SQL}[CAST((dayofyear(solar_date)-5)/15 AS INT) + 1] ELSE '' END AS solar_term
FROM v_lunar_base"""),
    "v_occasions": ((), """
SELECT p_partkey AS ord, p_brand AS deity_name, concat(p_brand, ' ', p_type) AS common_name,
  CAST(p_partkey % 12 + 1 AS INT) AS lunar_month, CAST((p_partkey*7) % 30 + 1 AS INT) AS lunar_day, p_type AS occasion_type,
  CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END AS honorific_source
FROM part"""),
    "v_routes": ((), """
SELECT p_partkey AS poi_id, s_suppkey AS route_id,
  CASE WHEN (p_partkey + s_suppkey) % 3 = 0 THEN 'lagi' ELSE 'recycle' END AS car_type,
  p_name AS poi_name, s_nationkey AS district_gid
FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey"""),
    "v_stops": ((), """
SELECT l_orderkey, l_linenumber, l_suppkey AS route_id, l_partkey AS poi_id,
  CASE WHEN l_linenumber % 2 = 1 THEN 'lagi' ELSE 'recycle' END AS car_type,
  concat(CAST(l_orderkey % 24 AS VARCHAR), ':', lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0')) AS bare,
  CASE WHEN l_orderkey % 5 = 0 THEN concat('班表時間：', CAST(l_orderkey % 24 AS VARCHAR), ':', lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0'))
    WHEN l_orderkey % 5 = 1 THEN concat('星期一,四：', CAST(l_orderkey % 24 AS VARCHAR), ':', lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0'),
      chr(10), '星期二,五,六：', lpad(CAST(l_suppkey % 24 AS VARCHAR), 2, '0'), ':', lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0'))
    WHEN l_orderkey % 5 = 2 THEN concat('星期三：', CAST(l_orderkey % 24 AS VARCHAR), ':', CAST(100 + l_partkey % 60 AS VARCHAR))
    WHEN l_orderkey % 5 = 3 THEN concat('星期日：', CAST(l_orderkey % 24 AS VARCHAR), ';30', chr(10), '星期六：08:15')
    ELSE '' END AS show_time,
  CASE WHEN l_suppkey % 4 = 0 THEN '星期三：21:05' WHEN l_suppkey % 4 = 1 THEN '停駛' ELSE '' END AS memo_time
FROM lineitem"""),
}


def with_views(names: str, body: str) -> str:
    """``body`` with the named views (and what they need) put in front as WITH clauses."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for dep in VIEWS[name][0]:
            need(dep)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        need(name)
    clauses = [f"{n} AS ({VIEWS[n][1].strip()})" for n in wanted]
    body, head = body.strip(), "WITH "
    if body.upper().startswith("WITH RECURSIVE "):
        head, body = "WITH RECURSIVE ", "WITH " + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        clauses.append(body[5:])
        return head + ",\n".join(clauses)
    return ("WITH " + ",\n".join(clauses) + "\n" if clauses else "") + body


WEEKDAY_SQL = sql_list(WEEKDAY_CHARS)

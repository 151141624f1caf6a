"""The four sources from raw rows to identified and validated points."""

from pyspark.sql import functions as F

from schedlake.operators import cities as C
from schedlake.operators import quality as Q
from schedlake.operators.identity import SLOT_COLUMNS
from schedlake.plans.normalising import entries_text
from schedlake.sources import dimensions, readers

SLOT = "city_slug string, district_slug string, base_key string, slot int, point_id string, plate string, route_scope string, first_arrive string"


def rows(spark, record, *dicts):
    schema = f"env_city string, env_source string, env_fetched_at string, ord bigint, r {record}"
    return spark.createDataFrame([("市", "來源", "2026-07-01", i, d) for i, d in enumerate(dicts)], schema).select("env_city", "env_source", "env_fetched_at", "ord", "r.*")


def shown(df):
    return {r["ord"]: r for r in df.withColumn("s", entries_text("schedule")).withColumn("rs", entries_text("recycling_schedule")).withColumn("fs", entries_text("foodscraps_schedule")).collect()}


def test_dictionaries(spark):
    sizes = {c: dimensions.districts(spark, c).count() for c in dimensions.TABLES}
    assert sizes == {"taichung": 29, "xinbei": 29, "taoyuan": 13, "kaohsiung": 36}
    assert tuple(dimensions.districts(spark, "taoyuan").filter("code = 'lagi2-004'").first()) == ("lagi2-004", "中壢區", "zhongli")


def test_wide_day_city(spark):
    day = {"area": " 中區 ", "village": "里", "caption": "路1號", "task_type": "定點", "car_licence": "AB-1", "g_d1_time_s": "16:10", "g_d1_time_e": "16:15", "r_d2_time_s": "9;1"}
    raw = rows(spark, readers.WIDE_DAYS, day, {**day, "area": "火星", "task_type": "夜間", "car_licence": ""}, {**day, "task_type": "往廠"}, {**day, "caption": "進焚化廠號"})
    got = shown(C.wide_day_city(raw, dimensions.districts(spark, "taichung")))
    assert set(got) == {0, 1}
    a, b = got[0], got[1]
    assert (a.district, a.district_slug, a.address, a.s, a.rs, a.collection_type, a.first_arrive) == ("中區", "zhongqu", "市中區路1號", "1@16:10-16:15", "", "定點清運", "16:10")
    assert a.notes == "車牌AB-1、原始r_d2時間格式異常:'9;1'/''" and a.foodscraps_schedule is None
    assert (b.district, b.district_slug, b.address, b.collection_type, b.plate) == (None, "unknown", None, "夜間", None)
    assert b.notes.endswith("原始清運方式無法對應:'夜間'")


def test_flag_day_city(spark):
    row = {"city": "萬里區", "village": " ", "name": "路", "time": "18:5", "latitude": "25.1", "longitude": "bad", "memo": "備註", "lineid": "L1", "garbagemonday": "Y", "recyclingfriday": "Y"}
    raw = rows(spark, readers.FLAG_DAYS, row, {**row, "time": "8:30", "longitude": None})
    got = shown(C.flag_day_city(raw, dimensions.districts(spark, "xinbei")))
    a, b = got[0], got[1]
    assert (a.s, a.rs, a.first_arrive, a.lat, a.lng) == ("", "", None, 25.1, None)
    assert a.notes == "原始 time 格式異常:'18:5'、經緯度格式異常:'25.1'/'bad'、備註"
    assert (b.s, b.rs, b.fs, b.first_arrive, b.route_scope, b.village, b.notes) == ("1@08:30-", "5@08:30-", "", "08:30", "L1", None, "備註")


def test_route_city(spark):
    schema = "file string, route_id string, car_type string, fetched_at string, pos int, poi_id bigint, poi_name string, show_memo string, lat double, lng double, arrive_time string, show_arrive_time string, show_memo_time string, show_recycle_arrive_time string, show_recycle_memo_time string"
    stop = lambda f, r, t, p, poi, a, m, ra, rm, bare="17:03": (f, r, t, "2026-07-01T00:00:00+08:00", p, poi, f"poi{poi}", "", 24.5, 121.0, bare, a, m, ra, rm)
    data = [
        stop("a", "R1", "lagi", 0, 1, "星期二：17:03", "星期一：17:04", "", ""),
        stop("b", "R1", "recycle", 0, 1, "", "", "星期五：18:00", ""),
        stop("b", "R1", "recycle", 1, 2, "", "", "班表時間：19:00", ""),
        stop("c", "R1", "lagi", 0, 3, "壞", "", "", "", None),
        stop("c", "R9", "lagi", 1, 1, "星期二：17:03", "", "", ""),
        stop("c", "R2", "lagi", 2, 1, "", "星期三：20:00", "", ""),
    ]
    routes = spark.createDataFrame([("R1", "lagi2-001", "0221222"), ("R2", "lagi2-002", "0")], "routing_id string, district_gid string, run_type string")
    stops, dims = spark.createDataFrame(data, schema), dimensions.districts(spark, "taoyuan")
    out = C.route_city(stops, routes, dims, "桃園市", "src")
    got = {r.plate: r for r in out.withColumn("s", entries_text("schedule")).withColumn("rs", entries_text("recycling_schedule")).collect()}
    assert set(got) == {"R1:1", "R1:2", "R2:1"}
    assert (got["R1:1"].s, got["R1:1"].rs, got["R1:1"].district_slug, got["R1:1"].first_arrive) == ("2@17:03-|1@17:04-", "5@18:00-", "luzhu", "17:03")
    assert (got["R1:2"].s, got["R1:2"].rs, got["R1:2"].village) == ("", "@19:00-", None)
    assert got["R2:1"].s == "3@20:00-"
    assert [r["ord"] for r in out.orderBy("ord").collect()] == sorted(r["ord"] for r in got.values())
    united = C.route_stops_united(stops, routes, dims).withColumnRenamed("recycling_entries", "recycling")
    c = Q.normalize_stats(united, []).first()
    assert (c.union_total, c.dropped_missing_district, c.dropped_empty_both, c.recycle_only_points, c.schedule_line_drops, c.schedule_memo_added, c.final_count) == (5, 1, 1, 1, 1, 2, 3)
    assert (c.schedule_listed, c.recycling_listed, c.recycling_absent, c.has_recycling) == (3, 1, 1, 2)


def test_grid_city_identified_and_validated(spark):
    both, none = "16:10~16:15\n(16:20~16:25)", "無清運"
    grid = spark.createDataFrame(
        [(0, "三民區", "115年07月21日", ["里", "P1", "路"] + [both] + [none] * 6), (1, "三民區", "115年07月21日", ["里", "", "路"] + [none] * 6 + [both]), (2, "三民區", "x", ["里", "", ""] + [none] * 7)],
        "ord bigint, district string, download_text string, cells array<string>",
    )
    points = C.grid_city(grid, dimensions.districts(spark, "kaohsiung"), "高雄市", "src")
    a = shown(points)
    assert (a[0].address, a[0].notes, a[1].notes, a[0].fetched_at, a[0].s, a[0].rs) == ("高雄市三民區路", "車牌P1", None, "2026-07-21T00:00:00+08:00", "1@16:10-16:15", "1@16:20-16:25")
    empty = spark.createDataFrame([], SLOT).select(*SLOT_COLUMNS)
    named, id_map = C.identify(points, empty, "kaohsiung", "KHH")
    assert {r.point_id.rsplit("-", 1)[0] for r in named.collect()} == {"KHH-SANMIN"} and id_map.count() == 2
    again, _ = C.identify(points, id_map, "kaohsiung", "KHH")
    assert {(r["ord"], r.point_id) for r in again.collect()} == {(r["ord"], r.point_id) for r in named.collect()}
    base = spark.createDataFrame([], "city_slug string, count bigint, updated_at string")
    report = Q.report(named, base, "city_slug", ["schedule", "recycling_schedule", "foodscraps_schedule"]).first()
    assert report.passed and report.total == 2


def test_calendar_whitelists(spark):
    days = spark.createDataFrame([("一", "0", ""), ("八", "1", "補假"), ("日", "2", "其他")], "weekday_char string, code string, memo string")
    got = C.calendar_violations(days, dimensions.CALENDAR_WEEKDAYS, dimensions.CALENDAR_CODES, dimensions.CALENDAR_MEMOS)
    assert sorted((r.column, r.value) for r in got.collect()) == [("code", "1"), ("memo", "其他"), ("weekday_char", "八")]

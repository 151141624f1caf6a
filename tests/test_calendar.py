"""Calendar operators on small fixtures."""

import datetime as dt

from schedlake.operators import calendar as C
from schedlake.operators import foreign as X

D = dt.date
SCHEMA = "d date, weekday int, is_holiday boolean, memo string"


def days(spark, rows):
    """rows: (iso date, holiday?, memo)"""
    return spark.createDataFrame([(D.fromisoformat(d), D.fromisoformat(d).isoweekday(), h, m) for d, h, m in rows], SCHEMA)


def span(start, end, named=None, work=()):
    out, d = [], D.fromisoformat(start)
    while d <= D.fromisoformat(end):
        memo = (named or {}).get(str(d), "")
        out.append((str(d), (d.isoweekday() >= 6 or bool(memo)) and str(d) not in work, memo))
        d += dt.timedelta(days=1)
    return out


def test_leave_plan_bridges_both_sides(spark):
    plans = C.described(C.leave_plans(days(spark, span("2027-06-05", "2027-06-13", {"2027-06-09": "端午節"})))).collect()
    assert len(plans) == 1
    p = plans[0]
    assert (str(p.start), str(p.end), p.total_days) == ("2027-06-05", "2027-06-13", 9)
    assert [str(d) for d in p.leave_dates] == ["2027-06-07", "2027-06-08", "2027-06-10", "2027-06-11"]
    assert p.title == "端午節拼假攻略"
    assert p.sentence == "請 4 天特休(2027-06-07、2027-06-08、2027-06-10、2027-06-11),可連休 9 天(2027-06-05 ~ 2027-06-13)。"


def test_no_plan_over_four_days_or_without_a_named_day(spark):
    far = span("2027-06-05", "2027-06-11", {"2027-06-11": "端午節"})
    assert C.leave_plans(days(spark, far)).count() == 0
    plain = [r for r in span("2027-06-05", "2027-06-13") if r[0] not in ("2027-06-10", "2027-06-11")]
    assert C.leave_plans(days(spark, plain)).count() == 0


def test_weekend_by_date_and_block_by_row(spark):
    rows = [("2027-03-05", True, ""), ("2027-03-06", True, ""), ("2027-03-07", True, "x"), ("2027-03-12", True, ""), ("2027-03-13", True, "")]
    d = days(spark, rows)
    assert [(str(r.start), r.days, r.names) for r in C.long_weekends(d).collect()] == [("2027-03-05", 3, ["x"])]
    assert [(str(r.start), str(r["end"]), r.rows) for r in C.holiday_blocks(d).collect()] == [("2027-03-05", "2027-03-13", 5)]


def test_weekends_stop_at_new_year(spark):
    d = days(spark, [(f"2027-12-{x}", True, "") for x in (30, 31)] + [("2028-01-01", True, ""), ("2028-01-02", True, "")])
    assert C.long_weekends(d).count() == 0


def test_next_interval_and_countdown(spark):
    w = spark.createDataFrame([(D(2026, 10, 9), D(2026, 10, 11), "b"), (D(2026, 9, 25), D(2026, 9, 28), "a"), (D(2027, 1, 1), D(2027, 1, 3), "c")], "start date, end date, title string")
    asked = ["2026-09-01", "2026-09-25", "2026-09-27", "2026-09-28", "2026-12-31", "2027-02-01"]
    a = spark.createDataFrame([(D.fromisoformat(x),) for x in asked + asked[:1]], "as_of date")
    got = {str(r.as_of): (r.title, r.status, r.line, r.n_rows) for r in C.countdown(C.next_interval(a, "as_of", w), "as_of").collect()}
    assert got["2026-09-01"] == ("a", "ahead", "下一個連假:a,還有 24 天", 2)
    assert got["2026-09-25"][2] == "連假中:a,今天開始,放到 09/28"
    assert got["2026-09-27"][2] == "連假中:a,放到 09/28"
    assert got["2026-09-28"][2] == "連假中:a,今天是最後一天"
    assert got["2026-12-31"][:2] == ("c", "ahead")
    assert got["2027-02-01"][:3] == (None, "none", None)


def test_festivals(spark):
    d = days(spark, [("2026-09-26", True, ""), ("2026-09-27", True, "中秋節"), ("2026-09-28", True, "孔子誕辰紀念日/教師節"), ("2027-09-15", True, "中秋節")])
    w = spark.createDataFrame([(2026, D(2026, 9, 25), D(2026, 9, 28))], "year int, start date, end date")
    got = {(r.year, r.name): (r.d, r.forms_long_weekend) for r in C.festival_check(d, w).collect()}
    assert got[2026, "中秋節"] == (D(2026, 9, 27), True) and got[2026, "教師節"] == (D(2026, 9, 28), True)
    assert got[2027, "中秋節"] == (D(2027, 9, 15), False) and got[2027, "端午節"] == (None, False)


def foreign(spark, rows):
    return spark.createDataFrame([(c, D.fromisoformat(d), n) for c, d, n in rows], "country string, d date, name string")


def test_cross_country(spark):
    home = days(spark, span("2030-01-01", "2030-12-31", {"2030-01-01": "開國紀念日"}, work=("2030-02-16",)))
    f = foreign(spark, [("jp", "2030-01-01", "元日"), ("jp", "2030-01-14", "成人の日"), ("jp", "2030-02-11", "建国記念の日"), ("jp", "2030-02-16", "X"),
                        ("sg", "2030-01-01", "New Year"), ("sg", "2030-02-11", "Chinese New Year"), ("sg", "2030-02-12", "Chinese New Year")])
    rules = spark.createDataFrame([("jp", "12-29", "01-03")], "country string, start_md string, end_md string")
    closures = X.closure_dates(home, rules, f)
    assert sorted(str(r.d) for r in closures.collect()) == ["2030-01-02", "2030-01-03", "2030-12-29", "2030-12-30", "2030-12-31"]
    w = spark.createDataFrame([(2030, D(2030, 2, 9), D(2030, 2, 11), 3)], "year int, start date, end date, days int")
    rows = X.compare_days(w, home, f, closures, ["jp", "sg"])
    one = X.weekend_sentence(X.per_weekend(rows, ["jp", "sg"]), w, {"jp": "日本", "sg": "新加坡"}).first()
    assert (one.jp_days, one.sg_days) == (1, 1) and "日本有 1 天是當地國定假日" in one.sentence
    work = {(r.country, str(r.d)): r.makeup for r in X.workday_holidays(home, f).collect()}
    assert work == {("jp", "2030-01-14"): False, ("jp", "2030-02-11"): False, ("jp", "2030-02-16"): True, ("sg", "2030-02-11"): False, ("sg", "2030-02-12"): False}
    y = X.compare_year(w, home, f, closures, ["jp", "sg"], {"jp": "日本", "sg": "新加坡"}).first()
    assert (y.long_weekends, y.jp_weekends, y.closure_dates, y.closure_workdays) == (1, 1, 5, 4)
    assert "其中 2 天台灣當天要上班。" in y.sg_sentence and "(含 1 天為台灣週末補班日)" in y.jp_sentence


def test_display_names(spark):
    df = spark.createDataFrame([("Chinese New Year",), ("Chinese New Year (Observed)",), ("Other Day",)], "n string")
    got = [r[0] for r in df.select(X.display_name(df.n)).collect()]
    assert got == ["農曆新年(Chinese New Year)", "農曆新年補假(Chinese New Year (Observed))", "Other Day"]

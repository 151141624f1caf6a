"""Lunar operators on a small hand-made dimension."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from schedlake.functions.dates import lunar_day_label, lunar_month_label
from schedlake.operators import lunar as L

D = dt.date
# (first solar day, lunar year, month, leap, length): the real months around two new years
MONTHS = [
    (D(2024, 12, 1), 2024, 11, False, 30), (D(2024, 12, 31), 2024, 12, False, 29), (D(2025, 1, 29), 2025, 1, False, 30), (D(2025, 2, 28), 2025, 2, False, 29),
    (D(2025, 3, 29), 2025, 3, False, 30), (D(2025, 4, 28), 2025, 4, False, 29), (D(2025, 5, 27), 2025, 5, False, 29), (D(2025, 6, 25), 2025, 6, False, 30),
    (D(2025, 7, 25), 2025, 6, True, 29), (D(2025, 8, 23), 2025, 7, False, 30), (D(2025, 9, 22), 2025, 8, False, 29), (D(2025, 10, 21), 2025, 9, False, 30),
    (D(2025, 11, 20), 2025, 10, False, 30), (D(2025, 12, 20), 2025, 11, False, 30), (D(2026, 1, 19), 2025, 12, False, 29), (D(2026, 2, 17), 2026, 1, False, 30),
    (D(2026, 3, 19), 2026, 2, False, 29), (D(2026, 4, 17), 2026, 3, False, 30), (D(2026, 5, 17), 2026, 4, False, 29), (D(2026, 6, 15), 2026, 5, False, 29),
    (D(2026, 7, 14), 2026, 6, False, 30), (D(2026, 8, 13), 2026, 7, False, 29), (D(2026, 9, 11), 2026, 8, False, 30),
]


@pytest.fixture(scope="module")
def lunar(spark):
    rows = [(s + dt.timedelta(days=i), y, m, i + 1, leap, "甲子", "龍") for s, y, m, leap, n in MONTHS for i in range(n)]
    df = spark.createDataFrame(rows, "solar_date date, lunar_year int, lunar_month int, lunar_day int, is_leap_month boolean, ganzhi string, zodiac string")
    term = F.when(F.col("solar_date") == F.lit(D(2025, 4, 4)), "清明").when(F.col("solar_date") == F.lit(D(2025, 12, 21)), "冬至").otherwise("")
    return df.withColumn("solar_term", term).withColumn("lunar_month_label", lunar_month_label(F.col("lunar_month"), F.col("is_leap_month"))).withColumn(
        "lunar_day_label", lunar_day_label(F.col("lunar_day"))
    )


def occasions(spark, *md):
    return spark.createDataFrame([(i, f"e{i}", m, d) for i, (m, d) in enumerate(md)], "ord bigint, deity_name string, lunar_month int, lunar_day int")


def test_lookups(spark, lunar):
    asked = spark.createDataFrame([(D(2026, 9, 21),), (D(2025, 8, 8),)], "d date")
    got = {r.d: (r.lunar_month, r.lunar_day, r.is_leap_month) for r in L.to_lunar(asked, "d", lunar).collect()}
    assert got == {D(2026, 9, 21): (8, 11, False), D(2025, 8, 8): (6, 15, True)}
    req = spark.createDataFrame([(1, 8, 15, False), (2, 6, 15, True)], "ord bigint, lunar_month int, lunar_day int, is_leap_month boolean")
    rows = {(r["ord"], r.lunar_year): (r.solar_date, r.not_exist) for r in L.to_solar(req, lunar, F.lit(2024), F.lit(2026)).collect()}
    assert rows[1, 2026] == (D(2026, 9, 25), False)
    assert rows[2, 2025] == (D(2025, 8, 8), False) and rows[2, 2024] == (None, True) and rows[2, 2026] == (None, True)


def test_boundary_year_and_known_dates(spark, lunar):
    occ = occasions(spark, (12, 8), (1, 9), (3, 23), (6, 24))
    dates = {}
    for r in L.occasion_dates(occ, lunar, F.lit(2025), F.lit(2026)).collect():
        dates.setdefault((r.lunar_month, r.lunar_day, r.solar_year), []).append(r.solar_date)
    assert dates[12, 8, 2025] == [D(2025, 1, 7)]
    assert (dates[1, 9, 2026], dates[3, 23, 2026], dates[6, 24, 2026]) == ([D(2026, 2, 25)], [D(2026, 5, 9)], [D(2026, 8, 6)])
    # day 1 of month 12 falls on 2024-12-31 and 2026-01-19, so never into 2025; day 12 of month 11 on 2024-12-12 and 2025-12-31
    odd = {(r.lunar_month, r.lunar_day, r.solar_year): (r.type, r.n) for r in L.exceptions(occasions(spark, (11, 12), (12, 1)), lunar, F.lit(2025), F.lit(2025)).collect()}
    assert odd == {(12, 1, 2025): ("type_year_boundary", 0)}
    around = L.around_missing(occasions(spark, (12, 1)), lunar, F.lit(2025), F.lit(2025)).first()
    assert (around.previous, around.next) == (D(2024, 12, 31), D(2026, 1, 19))


def test_day_thirty_falls_back(spark, lunar):
    rows = {r.solar_year: (r.solar_date, r.adjusted, r.adjust_note) for r in L.occasion_dates(occasions(spark, (7, 30)), lunar, F.lit(2025), F.lit(2026)).collect()}
    assert rows[2025] == (D(2025, 9, 21), False, "")
    assert rows[2026][:2] == (D(2026, 9, 10), True) and "以7月廿九為準" in rows[2026][2]
    assert [r.type for r in L.exceptions(occasions(spark, (7, 30)), lunar, F.lit(2026), F.lit(2026)).collect()] == ["type_29_30"]
    bad = L.exceptions(occasions(spark, (3, 5)), lunar, F.lit(2024), F.lit(2024))
    with pytest.raises(ValueError):
        L.require_known(bad)


def test_segments(spark, lunar):
    segs = L.segments(lunar)
    assert segs.count() == len(MONTHS)
    asked = spark.createDataFrame([(D(2025, 7, 25),), (D(2024, 11, 30),), (D(2026, 10, 11),)], "d date")
    got = {r.d: r.line for r in L.segment_lookup(asked, "d", segs).collect()}
    assert got == {D(2025, 7, 25): "今天農曆:甲子年閏六月初一"}
    y = {r.lunar_year: r for r in L.year_summary(lunar).collect()}[2025]
    assert (y.days, y.months, y.leap_month, y.leap_start, y.leap_end) == (384, 13, 6, D(2025, 7, 25), D(2025, 8, 22))


def test_festivals(spark, lunar):
    f = {(r.lunar_year, r.festival): r.solar_date for r in L.festivals(lunar).collect()}
    assert f[2024, "除夕"] == D(2025, 1, 28) and f[2025, "正月初一"] == D(2025, 1, 29) and f[2025, "中秋"] == D(2025, 10, 6)
    assert f[2025, "清明"] == D(2025, 4, 4) and f[2025, "冬至"] == D(2025, 12, 21)


def test_checks_find_a_missing_day(lunar):
    passed = lambda df: {r.check: r.passed for r in L.checks(df, [2025], ["清明", "冬至"]).collect()}
    good = passed(lunar)
    assert good["days_complete"] and good["month_length"] and good["leap_years"] and good["term_names"]
    broken = passed(lunar.filter(F.col("solar_date") != F.lit(D(2025, 9, 1))))
    assert not broken["days_complete"] and broken["leap_years"]


def test_upcoming(spark):
    dates = [D(2026, 9, 20), D(2026, 9, 21), D(2026, 9, 25), D(2026, 12, 31)]
    events = spark.createDataFrame([(d, i * 10 + j) for i, d in enumerate(dates) for j in range(1 if i != 2 else 3)], "solar_date date, ord bigint")
    asked = spark.createDataFrame([(D(2026, 9, 21),), (D(2026, 9, 21),), (D(2026, 9, 26),), (D(2027, 1, 1),)], "as_of date")
    got = {}
    for r in L.upcoming(asked, "as_of", events, "solar_date", "ord", 2).orderBy("rank").collect():
        got.setdefault(r.as_of, []).append((r.solar_date, r["ord"]))
    assert got == {D(2026, 9, 21): [(D(2026, 9, 21), 10), (D(2026, 9, 25), 20)], D(2026, 9, 26): [(D(2026, 12, 31), 30)]}


def test_documents(spark, lunar):
    occ = spark.createDataFrame(
        [(1, "x", "X", 7, 30, "聖誕", "聖誕"), (2, "x", "X", 1, 9, "萬壽", "誕降"), (3, "x", "X", 1, 9, "萬壽", "別名")],
        "ord bigint, deity_name string, common_name string, lunar_month int, lunar_day int, occasion_type string, honorific_source string",
    )
    docs = L.documents(occ, L.occasion_dates(occ, lunar, F.lit(2025), F.lit(2026)))
    o = docs.first().occasions
    assert [(x.lunar_month, x.lunar_label, x.honorific, len(x.dates)) for x in o] == [(1, "正月初九", "誕降", 2), (7, "七月三十", None, 2)]
    assert L.flatten_documents(docs).count() == 4


def test_documents_with_sources_and_rules(spark, lunar):
    occ = spark.createDataFrame(
        [(1, "x", "X", 7, 30, "聖誕", "聖誕", "https://a.org/1", None, "https://b.org/2"), (2, "y", "Y", 1, 9, "萬壽", "誕降", "", None, None)],
        "ord bigint, deity_name string, common_name string, lunar_month int, lunar_day int, occasion_type string, honorific_source string, source_1 string, source_2 string, source_3 string",
    )
    dates = L.occasion_dates(occ, lunar, F.lit(2025), F.lit(2026)).withColumn("adjusted", F.col("lunar_day") == 30)
    rules = spark.createDataFrame([("x", 7, 30, "rule")], L.SUBSTITUTIONS)
    notes = spark.createDataFrame([("y", 1, 9, "萬壽", "remark")], L.NOTES)
    docs = L.documents(occ, dates, notes=notes, substitutions=rules, hosts={"a.org": "A"})
    got = {r.deity_name: r.occasions[0] for r in docs.collect()}
    assert [tuple(s) for s in got["x"].sources] == [("https://a.org/1", "A"), ("https://b.org/2", "b.org")]
    assert got["x"].thirty_day_substitution == "rule" and got["x"].note is None
    assert got["y"].sources == [] and got["y"].note == "remark" and got["y"].thirty_day_substitution is None
    assert L.complete_documents(docs, rules).count() == 2
    bare = L.documents(occ, dates)
    with pytest.raises(ValueError, match="substitution_without_source"):
        L.complete_documents(bare, rules)
    gone = L.documents(occ, dates.filter("lunar_day = 30"), substitutions=rules)
    stale = spark.createDataFrame([("x", 7, 30, "rule"), ("z", 1, 30, "rule")], L.SUBSTITUTIONS)
    assert {(r.deity_name, r.problem) for r in L.document_problems(gone, stale).collect()} == {("y", "no_dates"), ("z", "stale_substitution")}


def test_missing_term_stops_the_festivals(spark, lunar):
    years = [r.lunar_year for r in lunar.filter(F.col("solar_term") == "冬至").select("lunar_year").distinct().collect()]
    have = lunar.filter(F.col("solar_term") == "清明").select("lunar_year").distinct().collect()
    whole = sorted(set(years) & {r.lunar_year for r in have})
    if whole:
        assert L.complete_festivals(lunar, whole[0], whole[0]).count() > 0
    with pytest.raises(ValueError, match="solar terms missing"):
        L.complete_festivals(lunar.withColumn("solar_term", F.lit("")), 2025, 2025)

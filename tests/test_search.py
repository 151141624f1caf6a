"""Address search on the six-point index."""

import random

import pytest

from schedlake.operators import search as S

POINTS = [
    (1, "高雄市", "kaohsiung", "三民區", "sanmin", "大連街1號", "大連里", "A1"),
    (2, "高雄市", "kaohsiung", "三民區", "sanmin", "大連街2號", None, "A2"),
    (3, "臺中市", "taichung", "三民區", "sanmin", "大連街9號", None, "B1"),
    (4, "新北市", "xinbei", "汐止區", "xizhi", "大連街5號", None, "C1"),
    (5, "臺中市", "taichung", "中區", "zhongqu", "台中路3號", None, "D1"),
    (6, "臺中市", "taichung", "大安區", "daan", "大安路10號", None, "E1"),
]
WANTED = {
    "高雄市三民區大連街": {"A1", "A2"},
    "高雄三民區大連街": {"A1", "A2"},
    "高雄市 三民區 大連街": {"A1", "A2"},
    "高雄市,三民區,大連街": {"A1", "A2"},
    "高雄三民大連街": {"A1", "A2"},
    "三民區大連街": {"A1", "A2", "B1"},
    "三民大連街": {"A1", "A2", "B1"},
    "新北市大連街": {"C1"},
    "高雄市大連街": {"A1", "A2"},
    "臺中市大連街": {"B1"},
    "台中大連街": {"B1"},
    "台高雄市三民區大連街": {"A1", "A2"},
    "台中路": {"D1"},
    "大安路": {"E1"},
    "大連街": {"A1", "A2", "B1", "C1"},
    "汐止區": {"C1"},
    "高雄市大連街1號": {"A1"},
    "大連街1號": {"A1"},
    "街": {"A1", "A2", "B1", "C1"},
    "不存在": set(),
    "  ,": set(),
}


@pytest.fixture(scope="module")
def points(spark):
    rows = [(o, c, cs, d, ds, n, v, f"X-{ds.upper()}-{s}") for o, c, cs, d, ds, n, v, s in POINTS]
    return spark.createDataFrame(rows, "ord bigint, city string, city_slug string, district string, district_slug string, point_name string, village string, point_id string")


def test_search_matrix(spark, points):
    queries = spark.createDataFrame([(q,) for q in WANTED] * 2, "text string")
    found = S.links(S.address_search(queries, points), points, "/trash/").collect()
    keys = {r[0]: r[1] for r in queries.distinct().select("text", S.search_text(queries.text)).collect()}
    slug = lambda r: r.href.rstrip("/").split("/")[-1]
    for q, want in WANTED.items():
        assert {slug(r) for r in found if r.q == keys[q]} == want, q
    sub = {(r.q, slug(r)): r["sub"] for r in found}
    assert sub["高雄市大連街1號", "A1"] == "三民區・大連里"
    assert sub["大連街1號", "A1"] == "高雄市三民區・大連里"
    assert all(r["sub"].startswith(("高雄市", "臺中市")) for r in found if r.q == "三民區大連街")


def test_limits(spark, points):
    queries = spark.createDataFrame([("大連街",)], "text string")
    got = S.address_search(queries, points, limit=2).orderBy("rank").collect()
    assert [(r["rank"], r["ord"]) for r in got] == [(1, 1), (2, 2)]


def test_index(spark, points):
    rows, cities, districts = S.search_index(points)
    assert [r.city_slug for r in cities.orderBy("city_idx").collect()] == ["kaohsiung", "taichung", "xinbei"]
    assert [(r.city_slug, r.district_slug) for r in districts.orderBy("district_idx").collect()] == [
        ("kaohsiung", "sanmin"), ("taichung", "sanmin"), ("taichung", "zhongqu"), ("taichung", "daan"), ("xinbei", "xizhi")
    ]
    assert rows.count() == 6


def test_name_hits_of_many_names(spark):
    """100,000 names, some very long, some beginning alike, against a plain search; rows follow the texts, not the longest name."""
    rnd = random.Random(2)
    letters = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉"
    names = {"".join(rnd.choice(letters) for _ in range(rnd.choice([1, 2, 3, 3, 4, 5, 6, 9, 40]))) for _ in range(100_000)}
    names |= {"甲乙丙丁" + "戊" * i for i in range(30)}
    listed = sorted(names)
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    texts += [t[:9] + rnd.choice(listed) + t[9:] for t in texts] + ["甲乙丙丁" + "戊" * 20 + "甲乙丙丁戊", "甲", "", "甲乙" * 30]
    texts = sorted(set(texts))
    df = spark.createDataFrame([(t,) for t in texts], "q string")
    tokens = spark.createDataFrame([(x,) for x in listed], "tok string")
    got = {(r.q, r.tok): r["at"] for r in S.name_hits(df, "q", tokens).collect()}
    want = {}
    for t in texts:
        for i in range(len(t)):
            for j in range(i + 2, len(t) + 1):
                if t[i:j] in names:
                    want.setdefault((t, t[i:j]), i + 1)
    assert got == want and any(len(tok) == 40 for _, tok in want)
    none = S.name_hits(df, "q", tokens.filter("false"))
    assert sorted(none.columns) == ["at", "q", "tok"] and none.count() == 0

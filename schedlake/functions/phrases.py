"""Sentence templates, chosen by shape and a stable variant number.

Fixed values: the published wording. Placeholders in braces are filled by ``fill``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Notice for unknown weekdays, and the query system of cities without their own.
UNKNOWN_NOTICE = "本站僅取得此清運點的到點時間,未取得{label}星期。完整班表請以{system}為準。"
GENERAL_SYSTEM = "官方查詢系統"

# Introduction of a point, by shape.
INTRO = {
    "no_times": ["{where} 位於{area},目前尚無公開時刻資料。"],
    "other_unknown": [
        "{where} 位於{area},此清運點僅提供{service},{arrival}。",
        "位於{spot}的「{name}」僅提供{service},{arrival}。",
    ],
    "other_varied": [
        "{where} 位於{area},此清運點僅提供{service},固定於{days}收運,不同星期的到站時間略有不同,詳見下方時刻表。",
        "位於{spot}的「{name}」僅提供{service},固定於{days}收運,各星期到站時間不盡相同,詳見下方時刻表。",
    ],
    "other_fixed": [
        "{where} 位於{area},此清運點僅提供{service},固定於{days} {arrival}。",
        "位於{spot}的「{name}」僅提供{service},固定於{days} {arrival}。",
    ],
    "unknown": [
        "{where} 位於{area},垃圾車{arrival}。",
        "位於{spot}的「{name}」,垃圾車{arrival}。",
        "這是{area}的其中一個清運點,垃圾車{arrival}。",
    ],
    "varied": [
        "{where} 位於{area},垃圾車在{days}收運,不同星期的到站時間略有不同,詳見下方時刻表。",
        "位於{spot}的「{name}」,垃圾車在{days}收運,各星期到站時間不盡相同,詳細時段請見下方時刻表。",
        "這是{area}的其中一個清運點,收運日固定在{days},但不同星期到站時間略有不同,詳見下方時刻表。",
    ],
    "passing": [
        "{where} 是{district}的沿街收運路段,垃圾車固定於{days} {time},行進中不停等,請提前在路邊準備好垃圾。",
        "位於{spot}的「{name}」,垃圾車在{days} {time},此處為沿街收運、車輛不會停留。",
        "這是{area}的其中一個沿街收運路段,收運日固定在{days},垃圾車{time},請提早在路邊等候。",
    ],
    "typed": [
        "{where} 是{district}的定點垃圾清運點,固定於{days} {time} 收運。",
        "位於{spot}的「{name}」清運點,垃圾車在{days}會於 {time} 之間停靠。",
        "這是{area}的其中一個定點清運站,收運時間固定在{days},每次停靠約 {time}。",
    ],
    "untyped": [
        "{where} 位於{area},垃圾車固定於{days} {time}。",
        "位於{spot}的「{name}」,垃圾車在{days} {time}。",
        "這是{area}的其中一個清運點,收運日固定在{days},垃圾車{time}。",
    ],
}

# The sentence of one weekday, by shape; the number is added to the seed.
DAY = {
    "recycling_only": (2, [
        "{name}僅提供資源回收收運,無一般垃圾清運服務,回收到站時間請見下方時刻表。",
        "本站僅取得{name}的資源回收班表,此點不提供一般垃圾清運,回收時間請參考下方時刻表。",
    ]),
    "foodscraps_only": (4, [
        "{name}僅提供廚餘回收,無一般垃圾清運服務,到站時間請見下方時刻表。",
        "本站僅取得{name}的廚餘回收班表,此點不提供一般垃圾清運,到站時間請參考下方時刻表。",
    ]),
    "no_data": (0, ["本站尚未取得{name}的收運時刻資料。"]),
    "passing": (0, [
        "今天({today})垃圾車{moment} 經過{name},此處為沿街收運、車輛不會停等,請提前在路邊等候。",
        "今天是{today},{name}為沿街收運路段,垃圾車{moment} 經過,請提早把垃圾拿到路邊。",
        "{name}今天({today})正常收運,垃圾車{moment} 經過此路段(沿街收運、不停留),建議提早 5 分鐘到路邊等候。",
    ]),
    "arrive_typed": (0, [
        "今天({today})垃圾車會來{name},預計 {arrive} 抵達,請提前將垃圾拿到定點等候。",
        "今天是{today},{name}有清運班次,清運車預計 {arrive} 抵達,別錯過。",
        "{name}今天({today})正常收運,預計 {arrive} 抵達,建議提早 5 分鐘到定點等候。",
    ]),
    "arrive_untyped": (0, [
        "今天({today})垃圾車會到{name},預計 {arrive} 抵達,請提前將垃圾拿到現場等候。",
        "今天是{today},{name}有清運班次,清運車預計 {arrive} 抵達,別錯過。",
        "{name}今天({today})正常收運,預計 {arrive} 抵達,建議提早 5 分鐘到場等候。",
    ]),
    "window": (0, [
        "今天({today})垃圾車會來{name},預計 {arrive}〜{depart} 停靠,請提前在時間內將垃圾拿到定點。",
        "今天是{today},{name}有清運班次,清運車抵達時間約 {arrive} 至 {depart},別錯過。",
        "{name}今天({today})正常收運,時間落在 {arrive}〜{depart} 之間,建議提早 5 分鐘到定點等候。",
    ]),
    "weekday_unknown": (1, [
        "本站未取得{name}的收運星期資料,無法確認今天是否收運,到站時間請見下方時刻表。",
        "{name}的收運星期本站尚未取得,到站時間請參考下方時刻表,詳細說明如下。",
    ]),
    "other_days": (1, [
        "今天({today}){name}沒有排定清運班次,這個點固定收運日為{days},請依時刻表安排倒垃圾時間。",
        "{today}垃圾車不會經過{name},此清運點的收運日固定在{days}。",
        "{name}今天({today})休收,下一個收運日請參考本頁時刻表(固定為{days})。",
    ]),
}

# Questions and answers of a point.
POINT_FAQ = [
    ("錯過這班垃圾車時間怎麼辦?", [
        "若錯過{name}這班垃圾車,可攜帶垃圾至其他清運點(見本頁「{heading}」區塊)在其收運時間內投放,或改於{district}清潔隊公告的其他收集地點處理,切勿任意棄置。",
        "錯過時間的話,建議查看本頁「{heading}」列出的清運點是否還在收運時段內;若都已過站,只能等下一個收運日,或洽詢{district}清潔隊詢問臨時收運方式。",
    ]),
    ("資源回收車也是這個時間嗎?", [
        "資源回收車通常與一般垃圾車同車次前來,停靠時間與本頁時刻表相同;可回收的紙類、瓶罐、塑膠請分類後交給隨車人員。",
        "{district}的資源回收多與垃圾車同時段清運,依本頁時刻表的到站時間分類好紙類、寶特瓶、鐵鋁罐等交由清潔隊員即可。",
    ]),
    ("大型垃圾可以放在這裡等清運嗎?", [
        "大型垃圾(家具、家電等)需另外向{city}環保局預約清運,不可直接放置在本清運點等候,以免影響巷道通行與被開罰。",
        "大型廢棄物不在定點清運範圍內,需先上{city}環保局網站或電洽預約,由清潔隊安排另外時段到府收運。",
    ]),
    ("廚餘要怎麼處理?", [
        "廚餘通常與一般垃圾同車次收運,請使用專用廚餘桶分裝生廚餘與熟廚餘,於垃圾車抵達時分開交付。",
        "本點的廚餘收運時間與一般垃圾相同,請依生廚餘、熟廚餘分類後,在垃圾車抵達時交給清潔隊員。",
    ]),
]

# Notes on a district.
DISTRICT_NOTE = [
    "{district}目前共有 {points} 個定點清運點,分布在 {villages} 個里,各點收運時間不同,請依下方列表或時段總表確認住家附近的班次。",
    "{district}內共列出 {points} 筆清運點資料,橫跨 {villages} 個里;垃圾車路線與時間每點不同,建議先找到自家最近的清運點再查看時刻表。",
]


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Template with its placeholders replaced; NULL values count as empty."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return template


def choose(templates: list[str], seed: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in templates]), F.pmod(seed, F.lit(len(templates))).cast("int"))

"""Address search for a table of queries.

City and district names are found by walking a trie of the names over the text, not by testing every name
against every query. The remaining words meet the points through
an index of one- to three-character grams; each needle looks up its rarest gram only and is
then verified on the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from schedlake.functions.text import search_text
from schedlake.operators.normalize import parse_id
from schedlake.operators.skew import first_rows
from schedlake.session import cut_lineage

# Suffixes that may be left out, characters that make a name a road, stray characters at the edges.
CITY_SUFFIX, DISTRICT_SUFFIX = "[市縣]$", "[區鄉鎮市]$"
ROAD_START = "^[路街道巷弄段里村號]"
STRAY_EDGE = "^[台市區縣鄉鎮]+|[台市區縣鄉鎮]+$"


def dictionaries(points: DataFrame, ord_col: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(cities, districts) with dense ids in first-seen order. Both have one row per place, hundreds at most, so a plain ranking is fine."""
    slug, _ = parse_id(F.col("point_id"))
    firsts = cut_lineage(
        points.withColumn("slug", slug)
        .filter("slug is not null")
        .groupBy("city_slug", F.col("slug").alias("district_slug"))
        .agg(F.min(ord_col).alias("first"), F.min_by("city", ord_col).alias("city"), F.min_by(F.coalesce("district", "slug"), ord_col).alias("district"))
    )
    cities = firsts.groupBy("city_slug").agg(F.min_by("city", "first").alias("city"), F.min("first").alias("first"))
    cities = cities.withColumn("city_idx", F.row_number().over(Window.orderBy("first")) - 1).drop("first")
    districts = firsts.drop("city").join(cities.select("city_slug", "city_idx"), "city_slug")
    # cities come one after the other in the index
    return cities, districts.withColumn("district_idx", F.row_number().over(Window.orderBy("city_idx", "first")) - 1).drop("first")


def search_index(points: DataFrame, ord_col: str = "ord") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points with dictionary ids, cities, districts); ids that cannot be parsed are left out."""
    cities, districts = dictionaries(points, ord_col)
    slug, rest = parse_id(F.col("point_id"))
    rows = points.withColumn("district_slug", slug).withColumn("point_slug", rest).filter("district_slug is not null")
    indexed = rows.join(districts.select("city_slug", "district_slug", "city_idx", "district_idx"), ["city_slug", "district_slug"])
    return indexed.select(ord_col, "city_idx", "district_idx", F.coalesce("point_name", F.lit("")).alias("name"), "village", "point_slug"), cities, districts


def _core(full: Column, suffix: str) -> Column:
    return F.when((F.length(full) > 2) & full.rlike(suffix), F.left(full, F.length(full) - 1)).otherwise(full)


def name_hits(df: DataFrame, text: str, tokens: DataFrame) -> DataFrame:
    """Rows of ``tokens`` whose ``tok`` (two characters or more) occurs in ``text``, each with its first position ``at``.

    The tokens form a trie that is walked from every position of a text at once, its depth doubling: where two characters begin a
    token four are looked up, then eight, and so on. A position leaves the walk where no token begins like it, so the
    rows grow with the length of the texts and with what begins there, not with the longest token.
    """
    names = tokens.select("tok", F.length("tok").alias("size")).filter("size >= 2").distinct()
    longest = names.agg(F.max("size")).first()[0] or 2
    n = F.length(text)
    starts = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    walk = df.withColumn("at", F.explode(starts)).withColumn("ends", F.array().cast("array<int>"))
    depth = 2
    while depth <= longest:
        # one row per node of this depth: the lengths of the tokens below it that end before the next depth
        ended = F.collect_set(F.when(F.col("size") < 2 * depth, F.col("size"))).alias("ended")
        nodes = names.filter(F.col("size") >= depth).groupBy(F.left("tok", F.lit(depth)).alias("head")).agg(ended)
        reached = F.length(text) - F.col("at") + 1 >= depth
        here = F.when(reached if depth == 2 else reached & F.col("open"), F.substr(F.col(text), F.col("at"), F.lit(depth)))
        walk = walk.withColumn("head", here).join(nodes, "head", "inner" if depth == 2 else "left")
        walk = walk.select(*df.columns, "at", F.concat("ends", F.coalesce("ended", F.array().cast("array<int>"))).alias("ends"), F.col("ended").isNotNull().alias("open"))
        depth *= 2
    found = walk.withColumn("size", F.explode("ends")).filter(n - F.col("at") + 1 >= F.col("size"))
    first = found.groupBy(*df.columns, F.substr(F.col(text), F.col("at"), F.col("size")).alias("tok")).agg(F.min("at").alias("at"))
    return first.join(tokens, "tok")


def _cut(text: Column, token: Column) -> Column:
    """Text without the first occurrence of the token."""
    at = F.instr(text, token)
    return F.when(token.isNotNull() & (at > 0), F.concat(F.left(text, at - 1), F.substr(text, at + F.length(token)))).otherwise(text)


def _tokens(names: DataFrame, name: str, suffix: str) -> DataFrame:
    named = names.withColumn("full", search_text(F.col(name)))
    named = named.withColumn("core", _core(F.col("full"), suffix))
    return named


def parse_queries(queries: DataFrame, cities: DataFrame, districts: DataFrame) -> DataFrame:
    """Distinct normalised queries ``q`` with the city and district ids they name and what is left of the text."""
    # each level below reads the one above twice, so every level is written once
    qs = cut_lineage(queries.select(search_text(F.col("text")).alias("q")).filter("q <> ''").distinct())
    city = cut_lineage(_tokens(cities, "city", CITY_SUFFIX))
    city_tokens = city.select("city_idx", F.col("full").alias("tok"), F.lit("full").alias("form")).unionByName(
        city.filter("core <> full").select("city_idx", F.col("core").alias("tok"), F.lit("core").alias("form"))
    )
    after = lambda text: F.substr(F.col(text), F.col("at") + F.length("tok"))
    hits = name_hits(qs, "q", city_tokens).filter((F.col("form") == "full") | ~after("q").rlike(ROAD_START))
    form = lambda f, c: F.when(F.col("form") == f, c)
    named = hits.groupBy("q").agg(
        *[F.collect_set(form(f, F.col("city_idx"))).alias(f"{f}_set") for f in ("full", "core")],
        *[F.min_by(form(f, F.col("tok")), form(f, F.col("city_idx"))).alias(f"{f}_tok") for f in ("full", "core")],
    )
    none = F.array().cast("array<int>")
    whole = F.size("full_set") > 0
    by_city = cut_lineage(qs.join(named, "q", "left").select(
        "q",
        F.coalesce(F.when(whole, F.col("full_set")).otherwise(F.col("core_set")), none).alias("cities"),
        _cut(F.col("q"), F.when(whole, F.col("full_tok")).otherwise(F.col("core_tok"))).alias("rest"),
    ))

    dist = cut_lineage(_tokens(districts, "district", DISTRICT_SUFFIX))
    names = dist.select("city_idx", "district_idx", F.explode(F.array_distinct(F.array("full", "core"))).alias("tok"), "full")
    scope = (F.size("cities") == 0) | F.array_contains("cities", F.col("city_idx"))
    is_full = F.col("tok") == F.col("full")
    usable = is_full | ((F.length(after("rest")) >= 2) & ~after("rest").rlike(ROAD_START))
    found = name_hits(by_city, "rest", names).filter(scope & usable)
    # the longest token wins, then the first district; a district's full name is longer than its short form
    best = found.groupBy("q").agg(F.min_by("tok", F.struct(-F.length("tok"), "district_idx")).alias("tok"))
    same = best.join(names, "tok").join(by_city.select("q", "cities"), "q").filter(scope).groupBy("q", "tok").agg(F.collect_set("district_idx").alias("districts"))
    return by_city.join(same, "q", "left").select(
        "q", "cities", F.coalesce("districts", none).alias("districts"), _cut(F.col("rest"), F.col("tok")).alias("rest")
    )


def _grams(text: Column, size: int) -> Column:
    n = F.length(text)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substr(text, i, F.lit(size))))).otherwise(
        F.array().cast("array<string>")
    )


def address_search(queries: DataFrame, points: DataFrame, limit: int = 20, ord_col: str = "ord") -> DataFrame:
    """(q, rank, point, score, stage, city_named): the best ``limit`` matches by match position, then index order.

    Stage 1 filters by the named places, stage 2 retries without stray edge characters, stage 3
    takes the whole text without a filter; the first stage with a match answers, and later stages look only at queries
    that are still open. Equal texts of a district are looked at once; of each, only its first ``limit`` points can be among
    the best.
    """
    indexed, cities, districts = search_index(points, ord_col)
    # the places and the parsed queries are read by several branches below; both are far smaller than the points
    cities, districts = cut_lineage(cities), cut_lineage(districts)
    parsed = cut_lineage(parse_queries(queries, cities, districts))
    dist_text = districts.select("district_idx", "city_idx", search_text(F.col("district")).alias("d_text"))
    texts = indexed.select("district_idx", search_text(F.concat("name", F.coalesce("village", F.lit("")))).alias("hay"), F.col(ord_col).alias("id"))
    texts = first_rows(texts, ["district_idx", "hay"], ["id"], limit).groupBy("district_idx", "hay").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    # one row per distinct text
    texts = texts.join(dist_text.select("district_idx", "d_text"), "district_idx").withColumn("full_hay", F.concat("hay", "d_text")).drop("d_text")

    filtered = (F.size("cities") > 0) | (F.size("districts") > 0)
    cleaned = F.regexp_replace("rest", STRAY_EDGE, "")
    stages = F.array_compact(
        F.array(
            F.when(filtered, F.struct(F.lit(1).alias("stage"), F.col("rest").alias("needle"))),
            F.when(filtered & (cleaned != F.col("rest")), F.struct(F.lit(2).alias("stage"), cleaned.alias("needle"))),
            F.struct(F.lit(3).alias("stage"), F.col("q").alias("needle")),
        )
    )
    needles = parsed.select("q", "cities", "districts", F.inline(stages))
    words = needles.filter("needle <> ''").select("needle").distinct()
    # a needle is looked up by its rarest run of three characters (of all its characters where it is shorter)
    n = F.length("needle")
    runs = F.when(n == 1, _grams(F.col("needle"), 1)).when(n == 2, _grams(F.col("needle"), 2)).otherwise(_grams(F.col("needle"), 3))
    own = cut_lineage(words.withColumn("gram", F.explode(runs)))
    # only grams that some needle has; written once, read by the frequencies and by both matching steps
    every = texts.withColumn("gram", F.explode(F.concat(*[_grams(F.col("full_hay"), size) for size in (1, 2, 3)])))
    gram_rows = cut_lineage(every.join(own.select("gram").distinct(), "gram", "left_semi"))
    frequency = gram_rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(frequency, "gram", "left").groupBy("needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    keyed = cut_lineage(needles.join(rarest, "needle", "left"))

    by_place = F.col("stage") < 3
    only_cities = F.size("districts") == 0
    in_districts = keyed.filter(by_place & ~only_cities).withColumn("district_idx", F.explode("districts"))
    in_cities = keyed.filter(by_place & only_cities).withColumn("city_idx", F.explode("cities")).join(dist_text.select("city_idx", "district_idx"), "city_idx")
    scoped = in_districts.unionByName(in_cities.drop("city_idx"))
    hay = F.when(only_cities, F.col("full_hay")).otherwise(F.col("hay"))
    answer = ["q", "stage", (F.instr("searched", F.col("needle")) - 1).alias("score"), "ids"]
    placed = scoped.filter("needle <> ''").join(gram_rows, ["district_idx", "gram"]).withColumn("searched", hay).select(*answer).filter("score >= 0")
    # nothing left to look for: the first points of the scope
    heads = first_rows(indexed.select("district_idx", F.col(ord_col).alias("id")), ["district_idx"], ["id"], limit).drop("rank")
    plain = scoped.filter("needle = ''").join(heads, "district_idx").select("q", "stage", F.lit(0).alias("score"), F.array("id").alias("ids"))
    found = cut_lineage(placed.unionByName(plain))
    still_open = keyed.filter("stage = 3").join(found.select("q").distinct(), "q", "left_anti")
    open_hits = still_open.join(gram_rows.drop("district_idx"), "gram").withColumn("searched", F.col("full_hay")).select(*answer).filter("score >= 0")
    hits = found.unionByName(open_hits).select("q", "stage", "score", F.explode("ids").alias("id"))

    best = first_rows(hits, ["q"], ["stage", "score", "id"], limit)
    # the first stage of a query answers; worse stages can only stand behind it
    best = best.withColumn("first_stage", F.min("stage").over(Window.partitionBy("q"))).filter("stage = first_stage").drop("first_stage").join(parsed.select("q", (F.size("cities") > 0).alias("city_named")), "q")
    return best.select("q", "rank", F.col("id").alias(ord_col), "score", "stage", (F.col("city_named") & (F.col("stage") < 3)).alias("city_named"))


def links(found: DataFrame, points: DataFrame, base: str, ord_col: str = "ord") -> DataFrame:
    """Search results with the name, place line and link of the point; the city is shown unless the query named one."""
    slug, rest = parse_id(F.col("point_id"))
    where = F.concat("district", F.when(F.coalesce("village", F.lit("")) != "", F.concat(F.lit("・"), "village")).otherwise(""))
    named = points.select(
        ord_col, F.coalesce("point_name", F.lit("")).alias("name"), "city", where.alias("where"),
        F.concat(F.lit(base), F.concat_ws("/", "city_slug", slug, rest), F.lit("/")).alias("href"),
    )
    sub = F.when(F.col("city_named"), F.col("where")).otherwise(F.concat("city", "where"))
    return found.join(named, ord_col).withColumn("sub", sub).drop("city", "where")

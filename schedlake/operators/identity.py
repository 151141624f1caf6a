"""Content-hash identifiers that stay stable across snapshots.

Rows of one address (city, district, base key) are matched to its stored slots:

1. equal plate, the k-th row with the k-th slot of that plate;
2. nearest first arrival inside one route scope, greedy in row order, lowest slot on ties;
3. leftover rows with leftover slots of the scope, in order;
4. new slots for the rest, numbered after the existing ones.

1, 3 and 4 are rank-to-rank joins on native Spark with ranks that spread one hot address
over many tasks. So is 2 as long as every row finds a slot of its own minute; from the first
row that does not, the choices of a group depend on each other, and the rest streams in
sorted batches through a small matcher that keeps only the free slots of the current group.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schedlake.functions.text import content_id
from schedlake.functions.times import minutes
from schedlake.operators.quality import duplicates, require_empty
from schedlake.operators.skew import spread_row_number
from schedlake.session import cut_lineage

GROUP = ["city_slug", "district_slug", "base_key"]
SLOT_COLUMNS = [*GROUP, "slot", "point_id", "plate", "route_scope", "first_arrive"]
NO_SCOPE = "\u0000"


def base_key(village: Column, name: Column) -> Column:
    """Identity of an address; a missing name is written 'None'."""
    return F.concat(F.coalesce(village, F.lit("")), F.lit("|"), F.coalesce(name, F.lit("None")))


def _point_id(prefix: Column, key: Column) -> Column:
    return F.concat(prefix, F.lit("-"), F.upper("district_slug"), F.lit("-"), content_id(key))


def fresh_ids(rows: DataFrame, ord_col: str = "ord", prefix: str = "prefix") -> DataFrame:
    """Ids for addresses without stored slots: the bare hash for a single row, else numbered hashes in row order. Adds slot."""
    ranked = spread_row_number(rows, GROUP, ord_col, "__k")
    sizes = rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("__n"))
    sized = ranked.join(sizes, GROUP, "inner")
    numbered = F.concat(F.col("base_key"), F.lit("#"), (F.col("__k") - 1).cast("string"))
    key = F.when(F.col("__n") == 1, F.col("base_key")).otherwise(numbered)
    return sized.withColumn("point_id", _point_id(F.col(prefix), key)).withColumn("slot", (F.col("__k") - 1).cast("int")).drop("__k", "__n")


def match_nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Greedy nearest-minute matching over batches sorted by (group, slots before rows, order).

    State: the free slots of the current group, queued per minute. Rows are never held back.
    """
    group, queues, open_minutes = None, {}, []
    for pdf in batches:
        out = []
        for key, is_row, order, minute in zip(pdf["gkey"], pdf["is_row"], pdf["ordinal"], pdf["minute"]):
            if key != group:
                group, queues, open_minutes = key, {}, []
            if not is_row:
                if minute not in queues:
                    queues[minute] = deque()
                    open_minutes.insert(bisect_left(open_minutes, minute), minute)
                queues[minute].append(order)
                continue
            if not open_minutes:
                continue
            at = bisect_left(open_minutes, minute)
            near = open_minutes[max(0, at - 1) : at + 1]
            best = min(near, key=lambda m: (abs(m - minute), queues[m][0]))
            out.append((key, order, queues[best].popleft()))
            if not queues[best]:
                del queues[best]
                open_minutes.remove(best)
        yield pd.DataFrame(out, columns=["gkey", "row_ord", "slot"])


def _ranked_pairs(rows: DataFrame, slots: DataFrame, keys: list[str], ord_col: str) -> DataFrame:
    """k-th row with k-th slot of the same keys."""
    a = spread_row_number(rows.select(*keys, ord_col), keys, ord_col, "__k")
    b = spread_row_number(slots.select(*keys, "slot"), keys, "slot", "__k")
    return a.join(b, [*keys, "__k"]).select(*[k for k in keys if k in GROUP], ord_col, "slot")


def _nearest_pairs(rows: DataFrame, slots: DataFrame, ord_col: str) -> DataFrame:
    """Greedy nearest matching by minute inside (address, scope).

    Until the first row of a group whose own minute has no free slot left, every row takes the
    next slot of its minute, so that part is a rank-to-rank join. Only the rows from there on
    depend on each other and go through the sequential matcher, with the slots still free.
    """
    scoped = [*GROUP, "scope"]
    timed = [*scoped, "minute"]
    a = cut_lineage(spread_row_number(rows.select(*timed, ord_col), timed, ord_col, "__k"))
    b = cut_lineage(spread_row_number(slots.select(*timed, "slot"), timed, "slot", "__k"))
    supply = b.groupBy(*timed).agg(F.count(F.lit(1)).alias("__free"))
    short = a.join(supply, timed, "left").filter(F.col("__k") > F.coalesce("__free", F.lit(0)))
    turn = short.groupBy(*scoped).agg(F.min(ord_col).alias("__turn"))
    early = a.join(turn, scoped, "left").filter(F.col("__turn").isNull() | (F.col(ord_col) < F.col("__turn")))
    exact = cut_lineage(early.join(b, [*timed, "__k"]).select(*GROUP, ord_col, "slot"))

    gkey = F.to_json(F.struct(*scoped)).alias("gkey")
    late_rows = a.join(exact.select(ord_col), ord_col, "left_anti").select(gkey, F.lit(True).alias("is_row"), F.col(ord_col).cast("long").alias("ordinal"), "minute")
    late_slots = b.join(exact.select(*GROUP, "slot"), [*GROUP, "slot"], "left_anti").select(gkey, F.lit(False).alias("is_row"), F.col("slot").cast("long").alias("ordinal"), "minute")
    both = late_rows.select("gkey").distinct().join(late_slots.select("gkey").distinct(), "gkey")
    stream = late_rows.unionByName(late_slots).join(both, "gkey", "left_semi").repartition("gkey").sortWithinPartitions("gkey", "is_row", "ordinal")
    matched = stream.mapInPandas(match_nearest, "gkey string, row_ord long, slot long")
    group_of = F.from_json("gkey", "city_slug string, district_slug string, base_key string")
    greedy = matched.withColumn("g", group_of).select(
        "g.*", F.col("row_ord").cast(rows.schema[ord_col].dataType).alias(ord_col), F.col("slot").cast("int").alias("slot")
    )
    return cut_lineage(exact.unionByName(greedy))


def assign_ids(rows: DataFrame, slots: DataFrame, ord_col: str = "ord", prefix: str = "prefix") -> tuple[DataFrame, DataFrame]:
    """(rows with point_id, slot and ``how``; the id map to store).

    ``rows``: city_slug, district_slug, base_key, plate, route_scope, first_arrive, a unique
    numeric ``ord_col`` and the id prefix. ``slots``: the stored map. Old slots that match
    nothing stay in the map and are never reused. Stops when an order number occurs twice, a row is left without an
    id, or an id would stand for several addresses.
    """
    scope = F.coalesce("route_scope", F.lit(NO_SCOPE))
    counts = slots.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n_slots"))
    all_rows = cut_lineage(rows.join(counts, GROUP, "left").withColumn("scope", scope).withColumn("minute", minutes(F.col("first_arrive"))))
    known, new = all_rows.filter("n_slots is not null"), all_rows.filter("n_slots is null")
    stored = cut_lineage(slots.withColumn("scope", scope).withColumn("minute", minutes(F.col("first_arrive"))))

    plated = "plate is not null and plate <> ''"
    by_plate = cut_lineage(_ranked_pairs(known.filter(plated), stored.filter(plated), [*GROUP, "plate"], ord_col))
    rows1 = known.join(by_plate.select(ord_col), ord_col, "left_anti")
    slots1 = stored.join(by_plate.select(*GROUP, "slot"), [*GROUP, "slot"], "left_anti")

    by_time = _nearest_pairs(rows1.filter("minute is not null"), slots1.filter("minute is not null"), ord_col)
    rows2 = rows1.join(by_time.select(ord_col), ord_col, "left_anti")
    slots2 = slots1.join(by_time.select(*GROUP, "slot"), [*GROUP, "slot"], "left_anti")

    by_place = cut_lineage(_ranked_pairs(rows2, slots2, [*GROUP, "scope"], ord_col))
    rows3 = rows2.join(by_place.select(ord_col), ord_col, "left_anti")

    minted = spread_row_number(rows3, GROUP, ord_col, "__k").withColumn("slot", (F.col("n_slots") + F.col("__k") - 1).cast("int"))
    minted = minted.withColumn("point_id", _point_id(F.col(prefix), F.concat("base_key", F.lit("#"), F.col("slot").cast("string")))).withColumn("how", F.lit("minted"))

    tagged = [p.select(ord_col, "slot", F.lit(how).alias("how")) for p, how in ((by_plate, "plate"), (by_time, "time"), (by_place, "order"))]
    pairs = tagged[0].unionByName(tagged[1]).unionByName(tagged[2])
    reused = known.join(pairs, ord_col).join(stored.select(*GROUP, "slot", "point_id"), [*GROUP, "slot"])
    fresh = fresh_ids(new, ord_col, prefix).withColumn("how", F.lit("fresh"))
    keep = [ord_col, *SLOT_COLUMNS, "how"]
    assigned = cut_lineage(reused.select(*keep).unionByName(minted.select(*keep)).unionByName(fresh.select(*keep)))
    untouched = slots.join(assigned.select(*GROUP, "slot"), [*GROUP, "slot"], "left_anti")
    id_map = untouched.select(*SLOT_COLUMNS).unionByName(assigned.select(*SLOT_COLUMNS))
    require_empty(duplicates(all_rows, [ord_col]), "order numbers occur twice")
    require_empty(all_rows.select(ord_col).join(assigned.select(ord_col), ord_col, "left_anti"), "rows without an id")
    require_empty(collisions(id_map), "ids made from several addresses")
    return assigned, id_map


def collisions(ids: DataFrame, key: str = "base_key") -> DataFrame:
    """Ids made from different keys inside a district. Minimum and maximum suffice, so no distinct set is built."""
    ends = ids.groupBy("city_slug", "district_slug", "point_id").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    return ends.filter("first_key <> last_key")

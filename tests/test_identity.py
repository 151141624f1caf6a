"""Identifiers against the sequential rules, and their stability."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from schedlake.operators import identity as I
from schedlake.operators.skew import spread_row_number

ROW = "ord bigint, city_slug string, district_slug string, base_key string, plate string, route_scope string, first_arrive string, prefix string"
SLOT = "city_slug string, district_slug string, base_key string, slot int, point_id string, plate string, route_scope string, first_arrive string"


def hashed(key):
    return hashlib.sha256(key.encode()).hexdigest()[:10].upper()


def minute(t):
    try:
        h, m = t.split(":")
        return int(h) * 60 + int(m)
    except (AttributeError, ValueError):
        return None


def sequential(rows, slots):
    """One group, in row order; returns ord -> id. rows: (ord, plate, scope, arrive), slots: [id, plate, scope, arrive]."""
    key, taken, out = "k", set(), {}
    if len(rows) == 1 and not slots:
        return {rows[0][0]: f"P-D-{hashed(key)}"}

    def take(row, j):
        taken.add(j)
        out[row[0]] = slots[j][0]

    for row in rows:
        hit = [j for j, s in enumerate(slots) if j not in taken and row[1] and s[1] == row[1]]
        if hit:
            take(row, hit[0])
    for row in rows:
        if row[0] not in out and minute(row[3]) is not None:
            near = [(abs(minute(s[3]) - minute(row[3])), j) for j, s in enumerate(slots) if j not in taken and s[2] == row[2] and minute(s[3]) is not None]
            if near:
                take(row, min(near)[1])
    for row in rows:
        hit = [j for j, s in enumerate(slots) if j not in taken and s[2] == row[2]]
        if row[0] not in out and hit:
            take(row, hit[0])
    n = len(slots)
    for row in rows:
        if row[0] not in out:
            out[row[0]] = f"P-D-{hashed(f'{key}#{n}')}"
            n += 1
    return out


def random_groups(seed, groups):
    rnd = random.Random(seed)
    pick = lambda xs: rnd.choice(xs)
    time = lambda: pick([None, "bad", f"{rnd.randrange(6, 9):02d}:{rnd.randrange(0, 60, 10):02d}"])
    rows, slots, want, ord_ = [], [], {}, 0
    for g in range(groups):
        district = f"d{g}"
        mine = []
        for _ in range(rnd.randrange(1, 8)):
            ord_ += 1
            mine.append((ord_, pick([None, "", "A", "B"]), pick([None, "r1", "r2"]), time()))
        old = [(f"S{g}-{j}", pick([None, "A", "B", "C"]), pick([None, "r1", "r2"]), time()) for j in range(rnd.choice([0, 0, 1, 3, 6]))]
        rows += [(o, "c", district, "k", p, s, t, "P") for o, p, s, t in mine]
        slots += [("c", district, "k", j, *s) for j, s in enumerate(old)]
        want.update({o: i.replace("P-D-", f"P-{district.upper()}-") for o, i in sequential(mine, old).items()})
    return rows, slots, want


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_sequential_rules(spark, seed):
    rows, slots, want = random_groups(seed, 300)
    assigned, id_map = I.assign_ids(spark.createDataFrame(rows, ROW), spark.createDataFrame(slots, SLOT))
    got = {r["ord"]: r.point_id for r in assigned.collect()}
    assert got == want
    stored = id_map.collect()
    places = [(r.district_slug, r.slot) for r in stored]
    assert len(places) == len(set(places))
    assert {s[4] for s in slots} <= {r.point_id for r in stored}


def test_rerun_on_own_output_keeps_ids(spark):
    rows, slots, _ = random_groups(3, 60)
    df = spark.createDataFrame(rows, ROW)
    first, id_map = I.assign_ids(df, spark.createDataFrame(slots, SLOT))
    again, id_map2 = I.assign_ids(df, id_map)
    # a known address never mints again
    assert again.filter("how in ('minted', 'fresh')").count() == 0
    assert id_map.count() == id_map2.count()
    third, _ = I.assign_ids(df, id_map2)
    ids = lambda a: {r["ord"]: r.point_id for r in a.collect()}
    assert ids(again) == ids(third)
    assert len(set(ids(again).values())) == df.count()


def test_one_hot_address(spark):
    """A third of all rows at one address: same result as the sequential rules."""
    rnd = random.Random(5)
    hot = [(i, None, None, f"{rnd.randrange(6, 22):02d}:{rnd.randrange(60):02d}") for i in range(1, 401)]
    old = [(f"S{j}", None, None, f"{rnd.randrange(6, 22):02d}:{rnd.randrange(60):02d}") for j in range(300)]
    rest = [(1000 + i, "c", f"x{i}", "k", None, None, "08:00", "P") for i in range(800)]
    rows = spark.createDataFrame([(o, "c", "hot", "k", p, s, t, "P") for o, p, s, t in hot] + rest, ROW)
    slots = spark.createDataFrame([("c", "hot", "k", j, *s) for j, s in enumerate(old)], SLOT)
    assigned, _ = I.assign_ids(rows, slots)
    want = {o: i.replace("P-D-", "P-HOT-") for o, i in sequential(hot, old).items()}
    assert {r["ord"]: r.point_id for r in assigned.filter("district_slug = 'hot'").collect()} == want


def test_hot_address_with_enough_slots_never_reaches_the_matcher(spark, monkeypatch):
    """Unchanged data: every row finds a slot of its minute, so no row needs the sequential part."""

    def refuse(batches):
        for pdf in batches:
            if len(pdf):
                raise AssertionError("sequential matcher used")
            yield pdf

    monkeypatch.setattr(I, "match_nearest", refuse)
    rows = [(i, "c", "hot", "k", None, None, f"{6 + i % 12:02d}:{i % 60:02d}", "P") for i in range(1, 301)]
    df = spark.createDataFrame(rows, ROW)
    fresh = I.fresh_ids(df)
    assigned, _ = I.assign_ids(df, fresh.select(*I.SLOT_COLUMNS))
    assert {(r["ord"], r.point_id, r.how) for r in assigned.collect()} == {(r["ord"], r.point_id, "time") for r in fresh.collect()}


def test_none_in_key_and_collision(spark):
    df = spark.createDataFrame([(None, None), ("v", "n")], "v string, n string")
    assert [r[0] for r in df.select(I.base_key(df.v, df.n)).collect()] == ["|None", "v|n"]
    ids = spark.createDataFrame([("c", "d", "ID", "a"), ("c", "d", "ID", "b"), ("c", "e", "ID", "a"), ("c", "d", "J", "a"), ("c", "d", "J", "a")], "city_slug string, district_slug string, point_id string, base_key string")
    assert [(r.district_slug, r.point_id) for r in I.collisions(ids).collect()] == [("d", "ID")]


def test_spread_ranks_equal_plain_ranks(spark):
    df = spark.range(2000).select((F.col("id") * 7919 % 100003).alias("o"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    got = {(r.k, r.o): r.rn for r in spread_row_number(df, ["k"], "o", "rn", width=5000).collect()}
    want, seen = {}, {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.o)):
        seen[r.k] = seen.get(r.k, 0) + 1
        want[r.k, r.o] = seen[r.k]
    assert got == want
    assert sorted(r.rn for r in spread_row_number(df, [], "o", "rn", width=9000).collect()) == list(range(1, 2001))


def test_hot_key_is_split_by_a_plain_join(spark):
    """A third of all rows on one key: AQE splits that key's partition, nothing is copied."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        facts = spark.range(0, 60000, numPartitions=6).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 5000).alias("k"))
        keyed = spark.range(-1, 5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        joined = facts.join(keyed, ["k"], "left")
        assert sum(r.v == 2 * r.k for r in joined.collect()) == 60000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_assignment_refuses_double_orders_and_collisions(spark):
    row = (1, "c", "d", "k", None, None, "08:00", "P")
    none = spark.createDataFrame([], SLOT)
    with pytest.raises(ValueError, match="order"):
        I.assign_ids(spark.createDataFrame([row, row], ROW), none)
    taken = f"P-D-{hashed('k')}"
    other = spark.createDataFrame([("c", "d", "another", 0, taken, None, None, None)], SLOT)
    with pytest.raises(ValueError, match="several addresses"):
        I.assign_ids(spark.createDataFrame([row], ROW), other)

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casario.operators import ranks, upsert

DAYS = [None, dt.datetime(2024, 1, 1, 8), dt.datetime(2024, 1, 1, 20), dt.datetime(2024, 1, 2, 9), dt.datetime(2024, 1, 3)]
RULES = {"date": "seen", "immutable": ("place",), "mutable": ("value", "seen")}
SCHEMA = "url string, seq bigint, place string, value int, seen timestamp"


def sequential(state, rows, force=False):
    """The fold, row by row: what the set-based operators must equal."""
    for place, value, seen in rows:
        if state is None:
            state = {"place": place, "value": value, "seen": seen}
        elif force or state["seen"] is None or seen is None or state["seen"].date() != seen.date():
            state = {**state, "value": value, "seen": seen}
    return state


def random_batches(seed, keys=120):
    rng = random.Random(seed)
    out = {}
    for k in range(keys):
        def some(n):
            return [(rng.choice("ab"), rng.randrange(1000), rng.choice(DAYS)) for _ in range(n)]

        out[f"/{k}"] = (some(rng.randrange(0, 4)), some(rng.randrange(0, 5)))
    return out


def frame(spark, batches, which):
    rows = [(u, i, *r) for u, both in batches.items() for i, r in enumerate(both[which])]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("force", [False, True])
def test_fold_and_merge_equal_the_sequential_loop(spark, force):
    batches = random_batches(7)
    first = upsert.fold_batch(frame(spark, batches, 0), force=force, **RULES)
    second = upsert.fold_batch(frame(spark, batches, 1), force=force, **RULES)
    merged = upsert.merge(first.drop("_runs"), second, force=force, **RULES)
    got = {r["url"]: r for r in merged.collect()}
    for url, (a, b) in batches.items():
        before = sequential(None, a, force)
        want = sequential(before, b, force)
        if want is None:
            assert url not in got
            continue
        r = got[url]
        assert (r["place"], r["value"], r["seen"]) == (want["place"], want["value"], want["seen"]), url
        expected = "insert" if before is None else "update" if want != before else None
        assert expected is None or r["_op"] == expected


def test_replay_changes_nothing(spark):
    batches = random_batches(8)
    for rows in batches.values():  # days must be known: a missing day always rewrites
        for batch in rows:
            batch[:] = [(p, v, s or DAYS[1]) for p, v, s in batch]
    folded = upsert.fold_batch(frame(spark, batches, 0), **RULES)
    once = upsert.merge(folded.drop("_runs").limit(0), folded, **RULES).drop("_op").cache()
    single = folded.where("_runs = 1")
    again = upsert.merge(once, single, **RULES)
    assert again.where("_op <> 'keep'").count() == 0
    assert sorted(map(str, upsert.merge(once, folded, **RULES).drop("_op").collect())) == sorted(map(str, once.collect()))


def test_hot_keys_are_cut_into_blocks_with_the_same_result(spark):
    rng = random.Random(9)
    rows = [("/hot", i * 3, "a", i, rng.choice(DAYS)) for i in range(500)]
    rows += [(f"/{i}", i, "a", i, rng.choice(DAYS)) for i in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain = upsert.mark_applied(df, date="seen").select("url", "seq", "applied")
    cut = upsert.mark_applied(df, date="seen", hot_rows=100, block=64).select("url", "seq", "applied")
    assert sorted(plain.collect()) == sorted(cut.collect())
    assert ranks.hot_keys(df, ["url"], 100).collect() == [("/hot",)]


def test_whole_rows_are_shuffled_once(spark):
    """Folding reads a key's rows in order and merges them by key: both need the same placing, that of the stored buckets."""
    df = spark.createDataFrame([("/a", 0, "a", 1, DAYS[1]), ("/a", 1, "b", 2, DAYS[4]), (None, 2, "c", 3, None), (None, 3, "d", 4, None)], SCHEMA)
    folded = upsert.fold_batch(df, partitions=3, **RULES)
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(url" in plan
    assert sorted(map(tuple, folded.collect()), key=str) == [("/a", "a", 2, DAYS[4], 2), (None, "c", 4, None, 2)]


def test_crowded_keys_fold_alike(spark):
    """Above the limit, only the first and the last applied row of a key are shuffled whole."""
    rng = random.Random(10)
    rows = [("/hot", i * 3, rng.choice("ab"), i, rng.choice(DAYS)) for i in range(500)]
    rows += [(None, i, "a", i, DAYS[1]) for i in range(150)]
    rows += [(f"/{i % 40}", i, rng.choice("ab"), i, rng.choice(DAYS)) for i in range(130)]
    df = spark.createDataFrame(rows, SCHEMA)
    plain, crowded = upsert.fold_batch(df, **RULES), upsert.fold_batch(df, hot_rows=100, block=64, **RULES)
    assert sorted(map(str, plain.collect())) == sorted(map(str, crowded.collect()))
    assert plain.count() == 42


def test_gate(spark):
    rows = [(DAYS[1], DAYS[2]), (DAYS[1], DAYS[3]), (None, DAYS[1]), (DAYS[1], None)]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp")
    opened = df.select(upsert.gate_opens(F.col("a"), F.col("b")).alias("o"), upsert.gate_opens(F.col("a"), F.col("b"), True).alias("f"))
    assert [tuple(r) for r in opened.collect()] == [(False, True), (True, True), (True, True), (True, True)]


def test_immutable_null_stays(spark):
    stored = spark.createDataFrame([("/a", None, 1, DAYS[1])], "url string, place string, value int, seen timestamp")
    new = spark.createDataFrame([("/a", 0, "b", 2, DAYS[3])], SCHEMA)
    row = upsert.merge(stored, upsert.fold_batch(new, **RULES), **RULES).first()
    assert (row["place"], row["value"], row["_op"]) == (None, 2, "update")


ACTIVE = "url string, location_id string, business_type string, listing_type string, updated_date timestamp"


def test_replace_segments(spark):
    now = DAYS[1]
    active = spark.createDataFrame(
        [("/1", "L", "RENTAL", "USED", now), ("/2", "L", "SALE", "USED", now), ("/3", "M", "RENTAL", "USED", now)], ACTIVE
    )
    batch = spark.createDataFrame(
        [("/2", "L", "RENTAL", "USED", now, 0), ("/4", "L", "RENTAL", "USED", now, 1), ("/4", "L", "RENTAL", "USED", now, 2)],
        ACTIVE + ", seq int",
    )
    segment = spark.createDataFrame([("RENTAL", "USED", "L")], "business_type string, listing_type string, location_id string")
    got = upsert.replace_segments(active, segment, batch)
    assert sorted((r["url"], r["business_type"]) for r in got.collect()) == [("/2", "SALE"), ("/3", "RENTAL"), ("/4", "RENTAL")]
    listings = spark.createDataFrame([("/2",), ("/3",)], "url string")
    assert [r["url"] for r in upsert.orphans(got, listings).collect()] == ["/4"]

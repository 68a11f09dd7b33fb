import datetime as dt
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from casario.operators import ranks, serve


def test_grouped_median_is_exact(spark):
    rng = random.Random(5)
    groups = {
        "one": [3.0],
        "two": [1.0, 2.0],
        "mixed": [rng.uniform(-1e6, 1e6) for _ in range(301)],
        "same": [7.5] * 400,
        "wide": [10.0 ** rng.uniform(-9, 12) for _ in range(200)],
        "close": [1e6 + i * 1e-4 for i in range(100)],
        "zeros": [0.0, -0.0, 0.0, -1.0, 1.0, 0.25],
        "cents": [round(rng.gauss(1000, 300), 2) for _ in range(1000)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [(None, 1.0), ("one", None), ("none", None)]
    rng.shuffle(rows)
    got = ranks.grouped_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "m")
    assert {r["g"]: r["m"] for r in got.collect()} == {g: statistics.median(v) for g, v in groups.items()}


def test_median_never_gathers_a_group(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    plan = ranks.grouped_median(df, ["g"], "v", "m")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan


def test_median_and_clusters_broadcast_no_values(spark):
    """Small files hold many values, and zoom levels multiply them past any estimate."""
    points = spark.range(1000).select(
        (F.col("id") % 7 / 10).alias("address_lat"), (F.col("id") % 5 / 10).alias("address_lon"), F.col("id").cast("double").alias("total_fee")
    )
    median = ranks.grouped_median(points.select(F.explode(F.array("address_lat", "address_lon")).alias("g"), "total_fee"), ["g"], "total_fee", "m")
    for df in (median, serve.clusters(points, levels=5)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_keys_at_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    found = ranks.keys_at(df.repartition(5), [F.col("k")], ["k"], [0, 1, 499, 999, 1000])
    assert {p: r["k"] for p, r in found.items()} == {0: 0, 1: 1, 499: 499, 999: 999}


@pytest.mark.parametrize("n", [23, 5, 3])
def test_contiguous_folds(spark, n):
    rows = ranks.with_contiguous_folds(spark.range(n).repartition(4), ["id"], 5).orderBy("id").collect()
    want = [f + 1 for f in range(5) for _ in range(n // 5 + (f < n % 5))]
    assert [r["fold"] for r in rows] == want


def test_folds_by_timestamp_ignore_the_process_time_zone(spark):
    days = spark.range(10).select(F.make_timestamp_ntz(F.lit(2024), F.lit(1), F.col("id") + 1, F.lit(0), F.lit(0), F.lit(0)).alias("t"))
    rows = ranks.with_contiguous_folds(days, ["t"], 5).orderBy("t").collect()
    assert [r["fold"] for r in rows] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


@pytest.fixture(scope="module")
def offers(spark):
    rng = random.Random(6)
    rows = [
        (f"/{i:03d}", rng.choice([None, 100.0, 200.0, 350.5]), rng.choice([None, 1, 2, 3]), rng.choice([None, 150.0, 2.5, 3.5]), "t",
         10.0, "FLAT", "E", rng.choice([None, 0.5, 1.5, 2.5]), rng.choice([None, -22.0]), -43.0)
        for i in range(100)
    ]
    return spark.createDataFrame(
        rows,
        "url string, total_fee double, bedrooms int, total_fee_predict double, title string, usable_area double, "
        "type_unit string, estacao string, distance double, address_lat double, address_lon double",
    ).cache()


SORTS = [[], [("bedrooms", "desc")], [("bedrooms", "asc"), ("distance", "desc")]]


@pytest.mark.parametrize("sort_by", SORTS)
@pytest.mark.parametrize("top_k", [1000, 0])
def test_pages_join_up_to_the_whole_order(offers, sort_by, top_k):
    ranked = serve.with_residual(offers)
    pages = [serve.page_of(ranked, p, 40, sort_by, top_k=top_k).collect() for p in range(4)]
    got = [r["url"] for page in pages for r in page]

    def null_last(value, direction):
        return (value is None, -(value or 0) if direction == "desc" else (value or 0))

    keys = sort_by or [("error", "asc")]
    rows = sorted(ranked.collect(), key=lambda r: (*[null_last(r[c], d) for c, d in keys], r["url"]))
    assert got == [r["url"] for r in rows]
    assert [len(p) for p in pages] == [40, 40, 20, 0]


def test_table_page_rounds_half_to_even_before_sorting(offers):
    rows = serve.table_page(offers, 0, 100, [("distance", "asc")]).collect()
    assert {r["distance"] for r in rows} == {None, 0.0, 2.0}
    assert {r["total_fee_predict"] for r in rows} == {None, 150.0, 2.0, 4.0}
    assert rows[0].title.startswith("[t](/") and list(rows[0].asDict()) == list(serve.TABLE_COLUMNS)


def test_range_drops_nulls(offers):
    rows = serve.within(offers, (100.0, 200.0), (1, 2)).collect()
    assert rows and all(100 <= r["total_fee"] <= 200 and 1 <= r["bedrooms"] <= 2 for r in rows)


def test_counts_and_bounds(offers):
    assert serve.page_count(offers).first()["pages"] == 4
    assert serve.page_count(offers.limit(0)).first()["pages"] == 1
    bounds = serve.widget_bounds(offers, "total_fee", 500).first()
    assert (bounds["total_fee_min"], bounds["total_fee_max"]) == (0, 500)
    missing = offers.where("address_lat is null").count()
    assert serve.missing_places(offers).first()["missing"] == missing
    cluster = serve.clusters(offers).first()
    assert (cluster["points"], cluster["lat"], cluster["lon"]) == (100 - missing, -22.0, -43.0)
    assert serve.centroid(offers).first()["lat"] == -22.0


def test_clusters_of_every_level(spark):
    rng = random.Random(12)
    rows = [(rng.uniform(-1, 1), rng.uniform(-1, 1), float(rng.randint(1, 40)) if k % 7 else None) for k in range(500)] + [(None, 0.5, 1.0), (0.5, None, 1.0)]
    df = spark.createDataFrame(rows, "address_lat double, address_lon double, total_fee double")
    want = {}
    for lat, lon, fee in rows[:500]:
        for level in range(4):
            side = 0.1 * 2**level
            want.setdefault((level, math.floor(lat / side), math.floor(lon / side)), []).append((lat, lon, fee))
    got = {(r["level"], r["cell_lat"], r["cell_lon"]): r for r in serve.clusters(df, 0.1, levels=4).collect()}
    assert set(got) == set(want)
    for key, points in want.items():
        fees = [fee for _, _, fee in points if fee is not None]
        assert got[key]["points"] == len(points) and got[key]["lat"] == pytest.approx(statistics.fmean(p[0] for p in points))
        assert got[key]["median_fee"] == (statistics.median(fees) if fees else None)
    assert serve.clusters(df.limit(0)).count() == 0


def test_stale_segments(spark):
    schema = "business_type string, listing_type string, location_id string"
    asked = spark.createDataFrame([("RENTAL", "USED", x) for x in "abc"], schema)
    active = spark.createDataFrame(
        [("RENTAL", "USED", "a", dt.datetime(2024, 1, 2, 3)), ("RENTAL", "USED", "b", dt.datetime(2024, 1, 1))],
        schema + ", updated_date timestamp",
    )
    stale = serve.stale_segments(active, asked, dt.date(2024, 1, 2))
    assert sorted(r["location_id"] for r in stale.collect()) == ["b", "c"]
    assert serve.stale_segments(active, asked, dt.date(2024, 1, 2), force=True).count() == 3


def test_labels(spark):
    from casario.functions import texts

    rows = [("RENTAL", 1000.0, 50.0, 1050.0), ("RENTAL", 1234.5, None, 1234.5), ("SALE", 500000.0, 700.0, 500700.0)]
    df = spark.createDataFrame(rows, "b string, p double, c double, t double")
    labels = [r[0] for r in df.select(texts.price_label(*[F.col(x) for x in "bpct"])).collect()]
    assert labels == [
        "Valor R$ 1.000,00/Mês | Valor Condomínio R$ 50,00/Mês | total R$ 1.050,00/Mês",
        "Valor R$ 1.234,50/Mês",
        "Valor R$ 500.000,00 | Valor Condomínio R$ 700,00/Mês | total R$ 500.000,00",
    ]


def test_location_names(spark):
    from casario.schemas import LOCATION_KEYS
    from casario.sources import locations

    path = "BR>Rio de Janeiro>NULL>Rio de Janeiro>Zona Norte>Tijuca"
    rows = [
        (1, "Rio de Janeiro", "RJ", "Zona Norte", path, "Rio de Janeiro", "Tijuca"),
        (2, "Rio de Janeiro", "RJ", "Zona Norte", path, "Rio", "Tijuca"),
        (3, "Outra", "RJ", "Z", "", "Rio de Janeiro", "Tijuca"),
        (4, "Rio de Janeiro", "RJ", "Zona Sul", "BR>Rio de Janeiro>NULL>Rio de Janeiro>Zona Sul>Lagoa", "Rio de Janeiro", "Lagoa"),
    ]
    directory = spark.createDataFrame(rows, "seq int, city string, stateAcronym string, zone string, locationId string, state string, neighborhood string")
    found = locations.search_locations(directory, "tijuca").drop("place").collect()
    assert [r["name"] for r in found] == ["Tijuca, Rio de Janeiro - RJ"] and found[0]["state"] == "Rio"
    assert list(found[0].asDict())[1:] == list(LOCATION_KEYS)


def test_pages_are_equal_at_any_depth(spark):
    rows = [(f"/{k}", float(k % 3)) for k in range(20)] + [(None, 1.0), (None, 1.0), ("/3", 0.0), ("/4", None), (None, None)]
    df = spark.createDataFrame(rows, "url string, error double")
    for number in range(7):
        shallow, deep = (serve.page_of(df, number, 4, top_k=top).collect() for top in (1000, 0))
        assert shallow == deep


def test_median_of_tiny_and_huge_values(spark):
    groups = {
        "tiny": [k * 1e-12 for k in range(1, 2001)], "mixed": [-1e300, -2.0, -1e-300, 0.0, 5e-324, 1.0, 1e308], "zero": [0.0, 0.0, -0.0],
        "powers": [2.0**k for k in range(-30, 31)], "near": [2.0**k - 2.0 ** (k - 52) for k in range(1, 40)], "negative": [-float(k) for k in range(100)],
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    got = ranks.grouped_median(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", "m").collect()
    assert {r["g"]: r["m"] for r in got} == {g: statistics.median(v) for g, v in groups.items()}


def test_stored_order(spark, tmp_path):
    """Every page equals the sorted rows, with ties, nulls and repeated rows, and reads few of the files."""
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None, f"u{k}"]), rng.choice([None, 1.0, 2.0, 3.0]), rng.randrange(3), {"k": k % 2}) for k in range(500)]
    df = spark.createDataFrame(rows, "url string, fee double, rooms int, extra map<string,int>").repartition(7)
    serve.store_order(df, f"{tmp_path}/order", [("fee", "desc")], file_rows=60)
    pages = [serve.stored_page(spark, f"{tmp_path}/order", p, 40) for p in range(14)]
    assert [p.count() for p in pages] == [40] * 12 + [20, 0]
    got = [tuple(r) for p in pages for r in p.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, rows))
    order = [(r[1] is None, -(r[1] or 0), r[0] is None, r[0] or "") for r in got]
    assert order == sorted(order)
    assert all(len(p.inputFiles()) <= 2 for p in pages) and len(spark.read.parquet(f"{tmp_path}/order/rows").inputFiles()) >= 9
    serve.store_order(df.limit(0), f"{tmp_path}/none", [("fee", "desc")])
    assert serve.stored_page(spark, f"{tmp_path}/none", 0).collect() == []

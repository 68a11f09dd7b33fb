import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from casario.operators import features, serve, trials, upsert
from casario.plans import refresh, train
from casario.plans.refresh import observe as observed
from casario.plans.catalog import learning, upserts
from casario.schemas import LISTING_TYPES, TRAINING_COLUMNS
from casario.sources import stations
from casario.sources.pages import overlaid
from casario.sources.tables import Store
from casario.streaming import ingest
from tests.pages_fixture import CONTEXT, page, record, rental, requests

BASE = "https://wiki.example"
INDEX = """<html><body><table><tr><th>Outra</th></tr><tr><td><a href="/wiki/X" title="X">x</a></td></tr></table>
<table><tr><th>Linha</th><th>Terminais</th></tr>
<tr><td><a href="/wiki/L1" title="Linha 1">1</a></td><td><a href="/wiki/Y" title="Y">y</a></td></tr>
<tr><td><a href="/wiki/L2" title="Linha 2">2</a></td><td>z</td></tr></table></body></html>"""
LINE = '<table><tr><td><a href="/wiki/Esta%C3%A7%C3%A3o_{0}">a</a></td><td><a href="/wiki/Esta%C3%A7%C3%A3o_{0}">a</a></td><td><a href="/wiki/Rua">r</a></td></tr></table>'
STATION = '<h1 id="firstHeading">Estação {0}</h1><a href="https://tools.wmflabs.org/geo?{0}">c</a>'
COORDS = '<div><span class="geo"><span class="latitude">{0}</span>; <span class="longitude">{1}</span></span></div>'


def test_station_harvest(spark):
    rows = [
        (f"{BASE}/wiki/Metro", INDEX),
        (f"{BASE}/wiki/L1", LINE.format("A")),
        (f"{BASE}/wiki/L2", LINE.format("B") + LINE.format("A") + LINE.format("C")),
        (f"{BASE}/wiki/Esta%C3%A7%C3%A3o_A", STATION.format("A")),
        (f"{BASE}/wiki/Esta%C3%A7%C3%A3o_B", STATION.format("B")),
        (f"{BASE}/wiki/Esta%C3%A7%C3%A3o_C", '<h1 id="firstHeading">Estação C</h1>'),
        ("https://tools.wmflabs.org/geo?A", COORDS.format("-22.91", "-43.2")),
        ("https://tools.wmflabs.org/geo?B", COORDS.format("-22.95", "-43.3")),
    ]
    pages = spark.createDataFrame(rows + rows[:1], "url string, html string")
    seeds = spark.createDataFrame([(f"{BASE}/wiki/Metro", "rj")], "url string, uf string")
    got = stations.harvest_stations(pages, seeds, BASE).orderBy("linha", "estacao").collect()
    assert [(r["linha"], r["estacao"], r["lat"], r["lng"], r["uf"]) for r in got] == [
        ("Linha 1", "Estação A", -22.91, -43.2, "rj"),
        ("Linha 2", "Estação A", -22.91, -43.2, "rj"),
        ("Linha 2", "Estação B", -22.95, -43.3, "rj"),
    ]
    assert stations.harvest_stations(pages, seeds.where("uf = 'sp'"), BASE).count() == 0


STATIONS = "linha string, estacao string, lat double, lng double, url string, uf string"


def _land(path, name, records, **more):
    path.mkdir(exist_ok=True)
    (path / name).write_text(page(records, **more) + "\n")


def test_refresh_cycle_end_to_end(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"), buckets=4)
    metro = spark.createDataFrame([("L", "Estação Uruguai", -22.93, -43.24, "/e", "rj")], STATIONS)
    asked = requests(spark)
    day1, day2 = dt.datetime(2024, 1, 1, 9), dt.datetime(2024, 1, 2, 9)
    segment = ("RENTAL", "USED", CONTEXT["locationId"])

    _land(tmp_path / "d1", "a.json", [record("/1"), record("/2", bedrooms="x"), record("/3")])
    rejects = refresh.refresh(store, _pages(spark, tmp_path / "d1"), asked, day1, metro)
    assert [r["reject_reasons"] for r in rejects.collect()] == [["not_numeric:bedrooms"]]
    rows = refresh.current(store, *segment).orderBy("url").collect()
    assert [r["url"] for r in rows] == ["https://portal.example/1", "https://portal.example/3"]
    assert rows[0]["estacao"] == "Estação Uruguai" and rows[0]["distance"] == pytest.approx(0, abs=1e-3)
    assert rows[0]["created"] is not None and rows[0]["total_fee_predict"] is None

    # same day: nothing is due, so nothing changes
    _land(tmp_path / "d2", "a.json", [record("/1", pricingInfos=rental("2000"), updatedAt="2021-06-03T00:00:00Z"), record("/4")])
    refresh.refresh(store, _pages(spark, tmp_path / "d2"), asked, day1, metro)
    assert refresh.current(store, *segment).count() == 2

    # next day: /1 changed day, /3 is gone from the active set but stays stored
    refresh.refresh(store, _pages(spark, tmp_path / "d2"), asked, day2, metro)
    rows = refresh.current(store, *segment).orderBy("url").collect()
    assert [(r["url"][-2:], r["total_fee"]) for r in rows] == [("/1", 2000.0), ("/4", 1050.0)]
    assert store.read("listing").count() == 3

    # forced on the same day with the same update date: the change gate is open
    _land(tmp_path / "d3", "a.json", [record("/4", pricingInfos=rental("10"))])
    refresh.refresh(store, _pages(spark, tmp_path / "d3"), asked, day2, metro, force=True)
    rows = refresh.current(store, *segment).collect()
    assert [(r["url"][-2:], r["total_fee"]) for r in rows] == [("/4", 10.0)]

    # an empty answer empties the segment
    (tmp_path / "d4").mkdir()
    (tmp_path / "d4" / "a.json").write_text(page([], total=0))
    refresh.refresh(store, _pages(spark, tmp_path / "d4"), asked, dt.datetime(2024, 1, 3), metro)
    assert refresh.current(store, *segment).count() == 0 and store.read("listing").count() == 3


def test_same_url_in_two_requests(spark, tmp_path):
    """Requests are taken one after the other, in the caller's order or that of their names."""
    asked = requests(spark, request_id="r1").union(requests(spark, request_id="r2"))
    (tmp_path / "in").mkdir()
    first, later = record("/1"), record("/1", updatedAt="2021-06-09T10:00:00Z", extra={"kept": [1, 2.50]})
    (tmp_path / "in" / "a.json").write_text("\n".join([
        page([later], request_id="r2"), page([first], request_id="r1"), "{broken", page(None, number=9, request_id="r2"),
    ]))
    for k, (order, day) in enumerate([(None, 9), ({"r1": 2, "r2": 1}, 1)]):
        numbered = asked if order is None else asked.withColumn("request_seq", F.when(F.col("request_id") == "r1", order["r1"]).otherwise(order["r2"]))
        store = Store(spark, str(tmp_path / f"t{k}"), buckets=4)
        rejects = refresh.refresh(store, _pages(spark, tmp_path / "in"), numbered, dt.datetime(2024, 1, 1))
        assert sorted(r["reject_reasons"][0] for r in rejects.collect()) == ["corrupt_page", "malformed_page"]
        row = store.read("listing").collect()
        assert len(row) == 1 and row[0]["updated_date"].day == day
    found = store.read("listing").first()
    assert '"state":"Rio de Janeiro"' in found["raw"]


def test_bucket_count_belongs_to_the_table(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4, listing_types={"url": "string"})
    store.replace_partitions("listing", store.with_bucket(spark.createDataFrame([("/1",)], "url string")))
    assert Store(spark, str(tmp_path)).buckets == 4
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path), buckets=16)


def _listings(store, rows):
    """(url, location, fee) as stored rows of one kind."""
    given = store.spark.createDataFrame(rows, "url string, location_id string, total_fee double").withColumns(
        {"business_type": F.lit("RENTAL"), "listing_type": F.lit("USED"), "updated_date": F.lit("2024-01-01").cast("timestamp")}
    )
    return store.with_bucket(given.select(*[(F.col(n) if n in given.columns else F.lit(None)).cast(t).alias(n) for n, t in store.types["listing"].items()]))


def _scans(df):
    """Files read and rows left by row groups, of every scan, after running ``df``."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.executedPlan()
        if node.nodeName().endswith("QueryStage"):
            node = node.plan()
        if node.nodeName().startswith("Scan parquet"):
            found.append((node.metrics().apply("numFiles").value(), node.metrics().apply("numOutputRows").value()))
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_merge_moves_no_stored_rows(spark, tmp_path):
    """Stored rows are joined in their buckets; folders no row of the batch belongs to keep their files."""
    store = Store(spark, str(tmp_path), buckets=8)
    store.replace_partitions("listing", _listings(store, [(f"/{i}", "L", 1.0) for i in range(200)]))
    files = {str(f) for f in (tmp_path / "listing").rglob("*.parquet")}
    assert len(files) == 8
    batch = _listings(store, [("/7", "L", 9.0), ("/new", "L", 5.0)]).drop("url_bucket").withColumn("seq", F.lit(1))
    batch = batch.withColumn("updated_date", F.lit("2024-01-02").cast("timestamp"))
    folded = upsert.fold_batch(batch)
    plan = upsert.merge(store.read("listing"), folded)._jdf.queryExecution().executedPlan().toString()
    stored_side = plan[plan.index("SortMergeJoin"):].split("+- Sort")[0]
    assert "Bucketed: true" in stored_side and "Exchange" not in stored_side
    touched = set(store.touched_buckets(batch))
    refresh.merge_into(store, batch)
    after = {str(f) for f in (tmp_path / "listing").rglob("*.parquet")}
    assert len(after) == 8 and len(files - after) == len(touched) < 8
    got = {r["url"]: r["total_fee"] for r in store.read("listing").collect()}
    assert len(got) == 201 and got["/7"] == 9.0 and got["/new"] == 5.0 and got["/8"] == 1.0
    # a store of its own, as another job has, sees the same rows
    assert Store(spark, str(tmp_path)).read("listing").count() == 201


def test_reads_skip_files_and_row_groups(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    spark._jsc.hadoopConfiguration().set("parquet.block.size", "1024")
    spark._jsc.hadoopConfiguration().set("parquet.block.row.count.limit", "100")
    try:
        store.replace_partitions("listing", _listings(store, [(f"/{i}", f"L{i % 20:02d}", float(i)) for i in range(8000)]))
    finally:
        spark._jsc.hadoopConfiguration().unset("parquet.block.size")
        spark._jsc.hadoopConfiguration().unset("parquet.block.row.count.limit")
    one = store.lookup("/4321")
    assert [r["total_fee"] for r in one.collect()] == [4321.0]
    [(n, rows)] = _scans(store.lookup("/4321"))
    assert n == 1 and rows <= 100
    assert store.lookup("/absent").count() == 0 and _scans(store.lookup("/absent"))[0][1] == 0
    segment = serve.in_segment(store.read("listing"), "RENTAL", "USED", "L03")
    assert segment.count() == 400
    [(n, rows)] = _scans(segment.select("url", "total_fee", "location_id"))
    assert n == 4 and 400 <= rows <= 2000


def test_older_layouts_are_refused(spark, tmp_path):
    spark.range(1).select(F.lit(4).alias("buckets")).write.parquet(str(tmp_path / "layout"))
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path))


def _pages(spark, path):
    from casario.sources.pages import read_pages

    return read_pages(spark, str(path))


def test_stream_ingest_takes_only_new_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "tables"), buckets=4)
    landing, asked = tmp_path / "in", requests(spark)
    _land(landing, "a.json", [record("/1"), record("/2")])
    for name, records, want in [("b.json", [record("/3")], 3), ("c.json", [record("/1")], 3)]:
        ingest.ingest_pages(spark, str(landing), asked, store, str(tmp_path / "offsets")).awaitTermination()
        _land(landing, name, records, number=2)
        ingest.ingest_pages(spark, str(landing), asked, store, str(tmp_path / "offsets")).awaitTermination()
        assert store.read("listing").count() == want


def test_stream_keeps_rejects_and_failures(spark, tmp_path):
    """A page that arrives a trigger after the failed page before it is cut, and nothing rejected is lost."""
    store = Store(spark, str(tmp_path / "tables"), buckets=4)
    landing, asked = tmp_path / "in", requests(spark)
    landing.mkdir()
    (landing / "a.json").write_text("\n".join([page([record("/1"), record("/2", bedrooms="x")]), page(None, number=2, status=500), "{broken"]))
    ingest.ingest_pages(spark, str(landing), asked, store, str(tmp_path / "offsets")).awaitTermination()
    (landing / "b.json").write_text(page([record("/3")], number=3))
    (landing / "c.json").write_text(page(None, number=1))
    ingest.ingest_pages(spark, str(landing), asked, store, str(tmp_path / "offsets"), files_per_trigger=1).awaitTermination()
    assert [r["url"][-2:] for r in store.read("listing").collect()] == ["/1"]
    rejects = spark.read.parquet(f"{store.root}/rejects").collect()
    assert sorted(r["reject_reasons"][0] for r in rejects) == ["corrupt_page", "malformed_page", "not_numeric:bedrooms"]


def test_triggers_leave_nothing_of_their_own(spark, tmp_path):
    """What a trigger writes for itself would add up over the life of a stream."""
    from pathlib import Path

    from casario.session import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file:"))
    store, landing, asked = Store(spark, str(tmp_path / "tables"), buckets=4), tmp_path / "in", requests(spark)
    _land(landing, "a.json", [record("/1"), record("/2")])
    _land(landing, "b.json", [record("/3")], number=2)
    before = set(shared.iterdir())
    ingest.ingest_pages(spark, str(landing), asked, store, str(tmp_path / "offsets"), files_per_trigger=1).awaitTermination()
    assert store.read("listing").count() == 3 and set(shared.iterdir()) == before


def test_landed_pages_are_compressed(spark, folder):
    from pathlib import Path

    from casario.plans.catalog import upserts

    pages, _ = upserts.landed_searches(spark, folder)
    assert {Path(f).suffix for f in pages.inputFiles()} == {".gz"}


def test_buckets_follow_the_rows():
    from casario.sources.tables import buckets_for

    assert [buckets_for(n) for n in (0, 1, 250_000, 250_001, 54_000_000)] == [1, 1, 1, 2, 216]


@pytest.fixture(scope="module")
def listings(spark):
    rng = random.Random(11)
    rows = []
    for i in range(120):
        area = rng.uniform(20, 200)
        rows.append(
            (f"/{i:03d}", rng.choice(["A", "B", None]), area, i % 9, rng.choice(["FLAT", "HOME", "LOFT", None]), i % 4, 1, 0, 1,
             rng.choice([["POOL", "GYM"], [], None, ["OTHER"]]), -22.9, None if i % 7 == 0 else -43.2, area * 30 + 100,
             rng.choice(["Estação Uruguai", "Estação X", None]), 10.0, dt.datetime(2024, 1, 1), None if i % 5 == 0 else dt.datetime(2024, 1, 3, 12))
        )
    return spark.createDataFrame(
        rows,
        "url string, neighborhood string, usable_area double, floors int, type_unit string, bedrooms int, bathrooms int, suites int, "
        "parking_spaces int, amenities array<string>, address_lat double, address_lon double, total_fee double, estacao string, "
        "distance double, created_date timestamp, updated_date timestamp",
    ).cache()



def _as_of():
    return F.lit("2024-01-10 00:00:00").cast("timestamp")


def test_feature_frame(spark, listings):
    frame = features.feature_frame(listings, None, _as_of())
    assert len(features.feature_names()) == 40 and len(frame.columns) == 42
    rows = {r["url"]: r for r in frame.collect()}
    for src in listings.collect():
        r = rows[src["url"]]
        assert r["type_unit_OTHERS"] == int(src["type_unit"] not in features.UNIT_TYPES)
        assert r["estação_Estação_Uruguai"] == int(src["estacao"] == "Estação Uruguai")
        assert r["estação_OTHERS"] == int(src["estacao"] != "Estação Uruguai")
        assert r["amenity_POOL"] == int("POOL" in (src["amenities"] or []))
        assert r["address_lon"] == (-999.0 if src["address_lon"] is None else -43.2)
        assert r["qtd_days_created"] == 9 and r["qtd_days_updated"] == (-1 if src["updated_date"] is None else 6)
        assert (r["neighborhood"] is None) == (src["neighborhood"] is None)


def test_feature_frame_as_written(spark, listings):
    rows = features.feature_frame(listings, None, _as_of(), as_written=True).collect()
    for r in rows:
        assert r["estação_OTHERS"] == r["type_unit_OTHERS"]
        assert not any(v for k, v in r.asDict().items() if k.startswith("amenity_") or k.startswith("estação_Est"))


def test_indicators_need_no_shuffle(listings):
    flags = {**features.one_hot(F.col("type_unit"), ["FLAT"], "t"), **features.multi_hot(F.col("amenities"), ["GYM"], "a")}
    plan = listings.select(*[c.alias(n) for n, c in flags.items()])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_category_share(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)] + [(None,), ("",)], "s string")
    got = {r["s"]: r["share"] for r in features.category_share(df, "s", 0.1).collect()}
    assert got == {"a": 0.6, "b": 0.3}


@pytest.fixture(scope="module")
def frame(listings):
    return features.feature_frame(listings, None, _as_of()).cache()


def test_training_reads_only_its_columns(spark, listings, tmp_path):
    store = Store(spark, str(tmp_path), buckets=4)
    whole = listings.select(*[
        (F.col(n) if n in listings.columns else F.lit(None)).cast(t).alias(n) for n, t in LISTING_TYPES.items()
    ])
    store.replace_partitions("listing", store.with_bucket(whole))
    frame = train.training_frame(store, _as_of())
    assert frame.count() == listings.count()
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = frame._jdf.queryExecution().sparkPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    read = [set(re.findall(r"(\w+):", part)) for part in re.findall(r"ReadSchema: struct<(.*)>", plan)]
    # the other scan is that of the fitted encoding
    assert max(read, key=len) == set(TRAINING_COLUMNS)


def test_cross_validation_and_search(spark, frame):
    names = features.feature_names()
    limits = {"n_estimators": (2, 3), "max_depth": (2, 3)}
    found = train.search(spark, frame, names, n_trials=2, folds=2, limits=limits, families=["RandomForestRegressor", "LGBMRegressor"])
    assert found.count() == 4
    runs = train.summarise(found).cache()
    assert runs.count() == 2
    model, errors = train.publish_best(runs, frame, names)
    assert set(errors) == {"mape", "rmse", "mae"} and errors["mae"] < 2000
    slow = runs.withColumn("metrics", F.transform_values("metrics", lambda k, v: F.when(k == "fit_time", 2000.0).otherwise(v)))
    with pytest.raises(ValueError):
        train.publish_best(slow, frame, names)


def test_search_does_not_depend_on_the_order_of_its_jobs(spark, frame):
    limits = {"n_estimators": (2, 2), "max_depth": (2, 2), "num_leaves": (2, 3)}

    def run(threads):
        found = train.search(spark, frame, features.feature_names()[:6], 5, folds=2, startup=4, limits=limits, threads=threads).collect()
        return [(r["run_id"], r["fold"], r["params"], {k: v for k, v in r["metrics"].items() if "time" not in k}) for r in found]

    together = run(6)
    # Spark's own boosting adds partial sums as they come in; a last digit may settle a tie between cuts
    for (*one, metrics), (*other, again) in zip(together, run(1), strict=True):
        assert one == other and metrics == pytest.approx(again, rel=0.02 if one[2]["model"] == "XGBRegressor" else 1e-6)
    assert len(together) == 10 and len({p["model"] for _, _, p, _ in together}) == 4


def test_publishing_searches_all_of_every_range(spark, folder, monkeypatch):
    asked = {}

    def search(spark, frame, names, n_trials, **given):
        asked.update(given, n_trials=n_trials)
        raise InterruptedError

    monkeypatch.setattr(learning.train, "search", search)
    with pytest.raises(InterruptedError):
        learning.publish_model(spark, folder)
    assert asked == {"n_trials": 100}


def test_model_with_log_target_survives_storage(spark, frame, tmp_path):
    names = features.feature_names()
    model = train.create_model(names, "ExtraTreesRegressor", True, True, n_estimators=5, max_depth=5, max_features="sqrt").fit(frame)
    store = Store(spark, str(tmp_path))
    store.save_model(model)
    first, again = (m.transform(frame).orderBy("url").select("prediction").collect() for m in (model, store.load_model()))
    assert first == again and all(0 < r["prediction"] < 10000 for r in first)


def test_out_of_fold_covers_every_row_once(frame):
    model = train.create_model(features.feature_names(), "LinearRegression")
    out = train.out_of_fold(frame, model, folds=3)
    assert out.count() == frame.count() == out.select("url").distinct().count()


def test_nothing_to_score(frame):
    assert train.predict(frame.limit(0), None) is None


def test_param_typing():
    assert [trials.typed_param(x) for x in ("12", "0.5", "True", "None", "sqrt", "1e-3")] == [12, 0.5, True, None, "sqrt", 1e-3]


def test_trials(spark):
    t = dt.datetime(2024, 1, 1)
    runs = [(i, t, t + dt.timedelta(seconds=s) if s else None) for i, s in [(1, 5), (2, 3), (3, 3), (4, None), (5, 9)]]
    found = spark.createDataFrame(runs, "trial_id int, datetime_start timestamp, datetime_complete timestamp")
    values = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.5), (4, 0.1)], "trial_id int, value double")
    best = trials.best_trials(trials.fastest_per_value(trials.complete_trials(found, values))).collect()
    assert [(r["trial_id"], r["value"], r["runtime"]) for r in best] == [(2, 0.5, dt.timedelta(seconds=3))]


def test_scoring_writes_predictions_back(spark, listings, tmp_path):
    names = features.feature_names()
    store = Store(spark, str(tmp_path), buckets=4)
    full = listings.where("neighborhood is not null")
    for c, t in store.types["listing"].items():
        if c not in full.columns:
            value = {"business_type": "RENTAL", "listing_type": "USED", "location_id": "L"}.get(c)
            full = full.withColumn(c, F.lit(value).cast(t))
    store.replace_partitions("listing", store.with_bucket(full))
    active = full.where("url < '/050'").select("url", "location_id", "business_type", "listing_type", F.col("created_date").alias("updated_date"))
    store.append("active", active)
    encoding = features.fit_neighborhood_encoding(full)
    model = train.create_model(names, "LinearRegression").fit(features.feature_frame(full, encoding, _as_of()))
    segments = active.select("business_type", "listing_type", "location_id").distinct()
    assert refresh.score_active(store, model, encoding, segments, dt.datetime(2024, 1, 10))
    rows = store.read("listing").collect()
    assert all((r["total_fee_predict"] is not None) == (r["url"] < "/050") for r in rows)
    assert not refresh.score_active(store, model, encoding, segments.limit(0), dt.datetime(2024, 1, 10))


def test_job_scratch_is_deleted(spark):
    from pathlib import Path

    from casario.session import cut_lineage, job_scratch

    with job_scratch(spark) as root:
        assert cut_lineage(spark.range(10)).count() == 10
        assert list(Path(root.removeprefix("file://")).iterdir())
    assert not Path(root.removeprefix("file://")).exists()


def test_stream_keeps_late_observations(spark, tmp_path):
    landing, rows, offsets = str(tmp_path / "landing"), str(tmp_path / "rows"), str(tmp_path / "offsets")
    schema = "url string, seen timestamp, n int"

    def land(*found):
        spark.createDataFrame(list(found), schema).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(schema).parquet(landing)
        ingest.merge_stream(stream, ingest.keep_fresh(rows, "url", "seen"), offsets).awaitTermination()

    def day(k, hour=0):
        return dt.datetime(2024, 1, k, hour)

    land(("a", day(20), 1), ("a", day(20, 5), 2), ("b", day(20), 3), ("a", None, 4))
    land(("a", day(20, 9), 5), ("c", day(21), 6))
    # far behind all that was seen: one is new, one is not; nulls are one day
    land(("a", day(3), 7), ("a", day(3, 1), 8), ("a", day(20), 9), ("a", None, 10), (None, day(3), 11))
    land(("a", day(3), 12), (None, day(3, 2), 13), ("b", day(4), 14))
    got = spark.read.schema(f"{schema}, trigger int").parquet(rows).select("url", F.col("seen").cast("date"), "trigger").collect()
    want = [
        ("a", day(20).date(), 0), ("b", day(20).date(), 0), ("a", None, 0), ("c", day(21).date(), 1),
        ("a", day(3).date(), 2), (None, day(3).date(), 2), ("b", day(4).date(), 3),
    ]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    # a new checkpoint numbers its triggers from 0 and sees all files again: nothing is kept twice or lost
    again = spark.readStream.schema(schema).parquet(landing)
    ingest.merge_stream(again, ingest.keep_fresh(rows, "url", "seen", run="second"), str(tmp_path / "other")).awaitTermination()
    assert spark.read.schema(schema).parquet(rows).count() == len(want)
    land(("d", day(5), 15))
    assert spark.read.schema(schema).parquet(rows).count() == len(want) + 1


def test_a_stream_of_pages_parses_them_in_its_triggers_only(spark, folder, tmp_path, monkeypatch):
    def read(*_):
        raise AssertionError("pages were parsed before they were sent")

    monkeypatch.setattr(upserts.pages, "read_pages", read)
    triggers = []
    monkeypatch.setattr(upserts.ingest, "observe", lambda landed, *given: triggers.append(landed.select("origin", "request_id", "page").collect()) or observed(landed, *given))
    found = upserts.stream_pages(spark, folder)
    first, again, later = sorted(triggers[:1]) + sorted(triggers[1:], key=lambda t: sorted(t) != sorted(triggers[0]))
    assert sorted(first) == sorted(again) and not set(first) & set(later) and len(set(first + later)) == len(first + later)
    assert found.count() == found.select("url").distinct().count() > 100


@pytest.mark.parametrize("text, want", [
    ('{"a": 1} ', '{"a": 1,"o":"p"}'), ("{}", '{"o":"p"}'), ("{ }", '{"o":"p"}'), (" {}", ' {,"o":"p"}'), ("", '{"o":"p"}'), ("[1]", '{"o":"p"}'),
    ('{"a": "漢é🙂" }', '{"a": "漢é🙂","o":"p"}'), ("é}", 'é"o":"p"}'), ("}", '"o":"p"}'), (None, '{"o":"p"}'),
])
def test_context_is_put_behind_the_record(spark, text, want):
    row = spark.createDataFrame([(text, "p")], "t string, o string")
    assert row.select(overlaid(F.col("t"), F.to_json(F.struct("o")))).first()[0] == want


def test_arriving_pieces_are_written_by_several_tasks(spark, folder, tmp_path):
    triggers = []
    stream = upserts.arriving(spark, folder, F.col("event_id")).withColumn("file", F.col("_metadata.file_name"))
    ingest.merge_stream(
        stream, lambda b, _: triggers.append(b.agg(F.min("event_id"), F.max("event_id"), F.count("*"), F.countDistinct("file")).first()),
        str(tmp_path / "offsets"),
    ).awaitTermination()
    assert len(triggers) == upserts.TRIGGERS and min(t[3] for t in triggers) > 1
    assert sum(t[2] for t in triggers) == spark.read.parquet(f"{folder}/events.parquet").count()
    assert all(a[1] < b[0] for a, b in zip(triggers, triggers[1:]))

import datetime as dt

import pytest

from casario.operators import clean
from casario.sources import pages
from tests.pages_fixture import CONTEXT, DROP, page, record, rental, requests

CASES = {
    "/plain": {},
    "/daily": {"pricingInfos": rental("100", "50", "DAILY")},
    "/no_condo": {"pricingInfos": rental(1000)},
    "/no_title": {"title": ""},
    "/no_point": {"address__point": DROP},
    "/no_street": {"address__street": DROP},
    "/no_number": {"address__streetNumber": ""},
    "/only_area": {"address__street": None, "address__streetNumber": None, "address__complement": None},
    "/equator": {"address__point": {"lat": 0.0, "lon": 0.0}},
    "/no_media": {"medias": None},
    "/empty_media": {"medias": []},
    "/decimal": {"usableAreas": "12.5"},
    "/number_list": {"usableAreas": [12]},
    "/null_price": {"pricingInfos": rental(None)},
    "/no_dates": {"createdAt": None, "updatedAt": None},
    "/words": {"bedrooms": ["abc"]},
    "/no_entry": {"pricingInfos": []},
    "/condo_only": {"pricingInfos": rental(None, "50")},
    "/daily_no_price": {"pricingInfos": rental(None, None, "DAILY")},
    "/no_rental_info": {"pricingInfos": [{"businessType": "RENTAL", "price": "1"}]},
    "/no_unit": {"unitTypes": []},
    "/bad_date": {"updatedAt": "soon"},
    "/scientific": {"bathrooms": "1e3"},
}


@pytest.fixture(scope="module")
def cleaned(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pages") / "p.json"
    path.write_text("\n".join([page([record(h, **c) for h, c in CASES.items()]), page(None, 2), "{broken"]))
    rows = pages.stamp(pages.records(pages.read_pages(spark, str(path))), requests(spark))
    return clean.clean_listings(rows).cache()


@pytest.fixture(scope="module")
def good(cleaned):
    return {r["url"].removeprefix(CONTEXT["site"]): r for r in clean.accepted(cleaned, keep=("seq",)).collect()}


@pytest.fixture(scope="module")
def bad(cleaned):
    return {r["url"].removeprefix(CONTEXT["site"]): r["reject_reasons"] for r in clean.rejected(cleaned).collect()}


def test_every_record_is_accounted_for(good, bad):
    assert set(good) | set(bad) == set(CASES) and not set(good) & set(bad)


def test_numbers(good):
    r = good["/plain"]
    assert (r["usable_area"], r["floors"], r["bedrooms"], r["bathrooms"], r["suites"], r["parking_spaces"]) == (70.0, 0, 2, 1, 0, 0)
    assert good["/decimal"]["usable_area"] == 12.5 and good["/number_list"]["usable_area"] == 12.0


def test_fees(good):
    assert good["/plain"]["total_fee"] == 1050.0
    assert good["/daily"]["total_fee"] == 3050.0
    assert good["/no_condo"]["total_fee"] == 1000.0 and good["/no_condo"]["condo_fee"] is None
    assert good["/null_price"]["total_fee"] is None


def test_sale_takes_its_own_entry(spark, tmp_path):
    (tmp_path / "p.json").write_text(page([record()]))
    asked = requests(spark, business_type="SALE")
    rows = pages.stamp(pages.records(pages.read_pages(spark, str(tmp_path))), asked)
    r = clean.accepted(clean.clean_listings(rows)).first()
    assert (r["price"], r["total_fee"]) == (500000.0, 500700.0)


def test_text_fields(good):
    assert good["/no_title"]["title"] == "x" * 40
    assert good["/plain"]["address"] == "Rua A, 10 - Tijuca (fundos)"
    assert good["/no_street"]["address"] == "10 - Tijuca (fundos)"
    assert good["/no_number"]["address"] == "Rua A - Tijuca (fundos)"
    assert good["/only_area"]["address"] == "Tijuca"
    assert good["/plain"]["images"] == ["https://img/crop/264x200/a.jpg"]
    assert good["/no_media"]["images"] == [] and good["/empty_media"]["images"] == []
    assert good["/plain"]["type_unit"] == "APARTMENT"


def test_coordinates_and_dates(good):
    assert good["/no_point"]["address_lat"] is None
    assert good["/equator"]["address_lat"] == 0.0
    assert good["/plain"]["updated_date"] == dt.datetime(2021, 6, 1, 10)
    assert good["/no_dates"]["created_date"] is None


def test_context_is_stamped_and_wins(good):
    r = good["/plain"]
    assert r["location_id"] == CONTEXT["locationId"] and r["zone"] == "Zona Norte"
    assert '"business_type":"RENTAL"' in r["raw"]


def test_reject_reasons(bad):
    assert bad == {
        "/words": ["not_numeric:bedrooms"],
        "/no_entry": ["no_pricing"],
        "/condo_only": ["no_price"],
        "/daily_no_price": ["no_price"],
        "/no_rental_info": ["no_rental_info"],
        "/no_unit": ["no_unit_type"],
        "/bad_date": ["bad_updated_date"],
        "/scientific": ["not_numeric:bathrooms"],
    }


def test_missing_context_is_rejected(spark, tmp_path):
    (tmp_path / "p.json").write_text(page([record()]))
    rows = pages.stamp(pages.records(pages.read_pages(spark, str(tmp_path))), requests(spark, zone=None))
    assert clean.rejected(clean.clean_listings(rows)).first()["reject_reasons"] == ["missing:zone"]


def test_record_keys_match_the_portal_contract(spark, tmp_path):
    from casario.schemas import CONTEXT_FIELDS, LISTING_FIELDS, RECORD_FIELDS

    assert [*RECORD_FIELDS, *CONTEXT_FIELDS] == [
        "listing", "account", "medias", "accountLink", "link", "site", "neighborhood", "locationId", "state", "city",
        "zone", "business_type", "listing_type", "origin",
    ]
    assert len(LISTING_FIELDS) == 40


def test_pages_malformed_and_failed(spark, tmp_path):
    rows = [page([record(f"/{i}")], i, total=99) for i in (1, 2)] + [page(None, 3, 500), page([record("/4")], 4), page(None, 5)]
    (tmp_path / "p.json").write_text("\n".join(rows))
    landed = pages.read_pages(spark, str(tmp_path))
    assert [r["page"] for r in pages.malformed(landed).collect()] == [5]
    assert sorted(r["page"] for r in pages.before_first_failure(landed).collect()) == [1, 2]
    assert pages.total_listings(landed).first()["total"] == 99


def test_failfast_stops(spark, tmp_path):
    (tmp_path / "p.json").write_text("{broken")
    with pytest.raises(Exception):
        pages.read_pages(spark, str(tmp_path), mode="FAILFAST").collect()


@pytest.mark.parametrize(
    "total, size, cap, first, want",
    [(100, 24, 50, 1, [1, 2, 3, 4, 5]), (100, 24, 2, 1, [1, 2]), (100, 24, -1, 0, [0, 1, 2, 3, 4]), (0, 24, 50, 1, [])],
)
def test_page_plan(spark, total, size, cap, first, want):
    plan = pages.plan_pages(spark.createDataFrame([("r", total)], "r string, total bigint"), size, cap, first)
    rows = plan.orderBy("page").collect()
    assert [r["page"] for r in rows] == want and [r["from"] for r in rows] == [p * size for p in want]


def test_raw_scan_keeps_unusual_entries(spark, cleaned):
    from pyspark.sql import functions as F

    stored = clean.accepted(cleaned).where(F.col("url").endswith("/daily") | F.col("url").endswith("/plain"))
    rows = pages.unusual_rentals(stored).collect()
    assert [(r["businessType"], r["period"]) for r in rows] == [("RENTAL", "DAILY")]

"""Raw records to typed listings, with the rejects kept and explained."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casario.functions import numbers, texts
from casario.schemas import LISTING_TYPES, RECORD_FIELDS, REQUIRED

# target column -> source field of the listing
_NUMBERS = {
    "usable_area": "usableAreas",
    "floors": "floors",
    "units_on_the_floor": "unitsOnTheFloor",
    "unit_floor": "unitFloor",
    "bedrooms": "bedrooms",
    "bathrooms": "bathrooms",
    "suites": "suites",
    "parking_spaces": "parkingSpaces",
}
_ZERO_WHEN_MISSING = ("floors", "suites", "parking_spaces")


def pick_pricing(infos: Column, business_type: Column) -> Column:
    """First pricing entry of the searched contract type."""
    return F.get(F.filter(infos, lambda p: p["businessType"] == business_type), F.lit(0))


def total_fee(business_type: Column, period: Column, price: Column, condo_fee: Column) -> Column:
    """Monthly cost: thirty days of a daily rental, plus the condo fee when there is one."""
    daily = (business_type == "RENTAL") & (period == "DAILY")
    return F.when(daily, price * 30).otherwise(price) + F.coalesce(condo_fee, F.lit(0.0))


def _reasons(checks: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]), lambda r: r.isNotNull())


def computed_once(df: DataFrame) -> DataFrame:
    """Same rows; a later filter is not pushed below (which would repeat the expressions in it)."""
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def clean_listings(records: DataFrame, as_written: bool = False) -> DataFrame:
    """Flattens and types stamped records; ``reject_reasons`` is empty for usable rows.

    ``records`` has the record fields, the search context and ``raw``. Other columns
    (page, position) pass through.
    """
    item, address = F.col("listing"), F.col("listing.address")
    pricing = F.col("_pricing")
    rental = F.col("business_type") == "RENTAL"
    priced = records.withColumn("_pricing", pick_pricing(item["pricingInfos"], F.col("business_type")))
    # first leave the nested record behind, so later stages carry only what they use
    fields = {
        **{f"_text_{t}": numbers.first_text(item[f]) for t, f in _NUMBERS.items()},
        "_text_price": numbers.first_text(pricing["price"]),
        "_text_condo_fee": numbers.first_text(pricing["monthlyCondoFee"]),
        "_text_created_date": texts.blank_to_null(item["createdAt"]),
        "_text_updated_date": texts.blank_to_null(item["updatedAt"]),
        "_no_pricing": pricing.isNull(),
        "_no_rental_info": rental & pricing.isNotNull() & pricing["rentalInfo"].isNull(),
        "url": F.concat("site", "link.href"),
        "location_id": F.col("locationId"),
        "title": texts.listing_title(item["title"], item["description"]),
        "amenities": item["amenities"],
        "type_unit": F.get(item["unitTypes"], F.lit(0)),
        "period": F.when(rental, pricing["rentalInfo"]["period"]),
        "address_lat": address["point"]["lat"],
        "address_lon": address["point"]["lon"],
        "address": texts.address_text(
            address["street"], address["streetNumber"], address["neighborhood"], address["complement"], as_written
        ),
        "images": texts.image_urls(F.col("medias")),
    }
    passed = [c for c in records.columns if c not in (*RECORD_FIELDS, "locationId")]
    staged = priced.select(*passed, *[c.alias(n) for n, c in fields.items()])
    quantities, dates = [*_NUMBERS, "price", "condo_fee"], ["created_date", "updated_date"]
    staged = staged.withColumns(
        {t: numbers.number_of(F.col(f"_text_{t}")) for t in quantities}
        | {d: F.try_to_timestamp(F.col(f"_text_{d}")) for d in dates}
    )
    condo_without_price = F.col("condo_fee").isNotNull() | F.coalesce(F.col("period") == "DAILY", F.lit(False))
    checks = {f"missing:{c}": F.col(c).isNull() for c in REQUIRED}
    checks |= {f"not_numeric:{t}": F.col(f"_text_{t}").isNotNull() & F.col(t).isNull() for t in quantities}
    checks |= {f"bad_{d}": F.col(f"_text_{d}").isNotNull() & F.col(d).isNull() for d in dates}
    checks |= {
        "no_title": F.col("title").isNull(),
        "no_unit_type": F.col("type_unit").isNull(),
        "no_pricing": F.col("_no_pricing"),
        "no_rental_info": F.col("_no_rental_info"),
        "no_price": ~F.col("_no_pricing") & F.col("_text_price").isNull() & condo_without_price,
    }
    zero = {t: F.coalesce(F.col(t), F.lit(0.0)) for t in _ZERO_WHEN_MISSING}
    fee = total_fee(F.col("business_type"), F.col("period"), F.col("price"), F.col("condo_fee"))
    flat = staged.withColumns({"total_fee": fee, "reject_reasons": _reasons(checks), **zero})
    return computed_once(
        flat.select(
            *[
                F.col(c).cast(LISTING_TYPES[c]).alias(c) if c in LISTING_TYPES else F.col(c)
                for c in flat.columns
                if not c.startswith("_")
            ]
        )
    )


def accepted(cleaned: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Usable rows with exactly the listing columns (station and audit columns come later)."""
    names = [n for n in LISTING_TYPES if n in cleaned.columns]
    return cleaned.where(F.size("reject_reasons") == 0).select(*names, *[c for c in keep if c in cleaned.columns])


def rejected(cleaned: DataFrame) -> DataFrame:
    return cleaned.where(F.size("reject_reasons") > 0).select("url", "origin", "reject_reasons", "raw")


def reject_counts(cleaned: DataFrame) -> DataFrame:
    return (
        cleaned.select(F.explode("reject_reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


def flatten(df: DataFrame, separator: str = ".") -> DataFrame:
    """Nested structs as top-level columns with dotted names."""

    def leaves(schema, path):
        for field in schema.fields:
            here = [*path, field.name]
            if hasattr(field.dataType, "fields"):
                yield from leaves(field.dataType, here)
            else:
                yield here

    return df.select(
        *[reduce(lambda c, n: c[n], p[1:], F.col(f"`{p[0]}`")).alias(separator.join(p)) for p in leaves(df.schema, [])]
    )

"""Text column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display labels of the stored codes (fixed values).
BUSINESS_LABELS = {"RENTAL": "Aluguel", "SALE": "Compra"}
LISTING_LABELS = {"USED": "Usado", "DEVELOPMENT": "Novo"}

# Size filled into image templates (fixed values).
IMAGE_SIZE = {"action": "crop", "width": "264", "height": "200"}


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def listing_title(title: Column, description: Column) -> Column:
    return F.coalesce(blank_to_null(title), F.substring(description, 1, 40))


def address_text(
    street: Column, number: Column, neighborhood: Column, complement: Column, as_written: bool = False
) -> Column:
    """``street, number - neighbourhood (complement)``.

    Missing parts are left out; ``as_written`` prints them as ``None``.
    """
    has_number, has_street = blank_to_null(number).isNotNull(), blank_to_null(street).isNotNull()
    if as_written:
        def text(c: Column) -> Column:
            return F.coalesce(c, F.lit("None"))

        base = (
            F.when(has_number, F.concat(text(street), F.lit(", "), text(number), F.lit(" - "), text(neighborhood)))
            .when(has_street, F.concat(text(street), F.lit(" - "), text(neighborhood)))
            .otherwise(text(neighborhood))
        )
    else:
        road = F.concat_ws(", ", blank_to_null(street), blank_to_null(number))
        base = F.concat_ws(" - ", blank_to_null(road), blank_to_null(neighborhood))
    extra = F.when(blank_to_null(complement).isNotNull(), F.concat(F.lit(" ("), complement, F.lit(")")))
    return F.concat(base, F.coalesce(extra, F.lit("")))


def image_urls(medias: Column, size: dict[str, str] = IMAGE_SIZE) -> Column:
    """Media urls with the size placeholders filled; never null."""

    def fill(media: Column) -> Column:
        return reduce(
            lambda url, kv: F.replace(url, F.lit("{" + kv[0] + "}"), F.lit(kv[1])), size.items(), media["url"]
        )

    return F.coalesce(F.transform(medias, fill), F.array().cast("array<string>"))


def location_name(location_id: Column, state_code: Column) -> Column:
    """``neighbourhood, city - STATE`` out of the ``>``-separated location path."""
    parts = F.split(F.concat(location_id, F.lit(">"), state_code), ">")
    return F.concat(
        F.try_element_at(parts, F.lit(-2)),
        F.lit(", "),
        F.get(parts, F.lit(3)),
        F.lit(" - "),
        F.try_element_at(parts, F.lit(-1)),
    )


def markdown_link(title: Column, url: Column) -> Column:
    return F.concat(F.lit("["), title, F.lit("]("), url, F.lit(")"))


def currency(value: Column) -> Column:
    """Brazilian money text: ``R$ 1.234,56``."""
    digits = F.translate(F.format_number(F.abs(value), 2), ",.", ".,")
    return F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), F.lit("R$ "), digits)


def price_label(business_type: Column, price: Column, condo_fee: Column, total_fee: Column) -> Column:
    """Price line of a listing: rental with condo fee, rental without, or sale."""
    condo = F.coalesce(condo_fee, F.lit(0.0))
    return (
        F.when(
            (business_type == "RENTAL") & (condo > 0),
            F.concat(
                F.lit("Valor "), currency(price), F.lit("/Mês | Valor Condomínio "), currency(condo),
                F.lit("/Mês | total "), currency(total_fee), F.lit("/Mês"),
            ),
        )
        .when(business_type == "RENTAL", F.concat(F.lit("Valor "), currency(price), F.lit("/Mês")))
        .otherwise(
            F.concat(
                F.lit("Valor "), currency(price), F.lit(" | Valor Condomínio "), currency(condo),
                F.lit("/Mês | total "), currency(price),
            )
        )
    )


def label_of(code: Column, labels: dict[str, str]) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.try_element_at(mapping, code)


def filter_sentence(price_min: Column, price_max: Column, rooms_min: Column, rooms_max: Column) -> Column:
    return F.format_string(
        "Selecionado imóveis com valores entre [%s,%s] e que possuam a quantidade [%s,%s] de quartos",
        *[c.cast("string") for c in (price_min, price_max, rooms_min, rooms_max)],
    )


def station_key(name: Column) -> Column:
    """Station heading in the spelling of the allow-list."""
    return F.replace(name, F.lit(" "), F.lit("_"))

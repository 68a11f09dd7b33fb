"""Hand-written portal records and page files."""

from __future__ import annotations

import copy
import json

CONTEXT = {
    "site": "https://portal.example",
    "neighborhood": "Tijuca",
    "locationId": "BR>Rio de Janeiro>NULL>Rio de Janeiro>Zona Norte>Tijuca",
    "state": "Rio de Janeiro",
    "city": "Rio de Janeiro",
    "zone": "Zona Norte",
    "business_type": "RENTAL",
    "listing_type": "USED",
    "origin": "portal",
}

RECORD = {
    "listing": {
        "title": "Apartamento",
        "description": "x" * 100,
        "amenities": ["POOL", "GYM"],
        "usableAreas": ["70"],
        "floors": [],
        "unitTypes": ["APARTMENT", "FLAT"],
        "unitsOnTheFloor": 4,
        "unitFloor": 2,
        "bedrooms": [2],
        "bathrooms": "1",
        "suites": "",
        "parkingSpaces": None,
        "createdAt": "2021-05-01T10:00:00Z",
        "updatedAt": "2021-06-01T10:00:00Z",
        "address": {
            "street": "Rua A",
            "streetNumber": "10",
            "neighborhood": "Tijuca",
            "complement": "fundos",
            "point": {"lat": -22.93, "lon": -43.24},
        },
        "pricingInfos": [
            {"businessType": "SALE", "price": "500000", "monthlyCondoFee": "700"},
            {"businessType": "RENTAL", "price": "1000", "monthlyCondoFee": "50", "rentalInfo": {"period": "MONTHLY"}},
        ],
    },
    "account": {"id": "1"},
    "medias": [{"url": "https://img/{action}/{width}x{height}/a.jpg"}],
    "accountLink": {"href": "/a"},
    "link": {"href": "/l/1"},
}


def record(href="/l/1", **changes) -> dict:
    """A copy of the sample record; keys are dotted paths below ``listing`` (or `medias`, `link`)."""
    out = copy.deepcopy(RECORD)
    out["link"]["href"] = href
    for path, value in changes.items():
        node = out if path in ("medias", "link") else out["listing"]
        *parents, last = path.split("__")
        for p in parents:
            node = node[p]
        if value is DROP:
            node.pop(last, None)
        else:
            node[last] = value
    return out


DROP = object()


def rental(price, condo=None, period="MONTHLY"):
    entry = {"businessType": "RENTAL", "price": price, "rentalInfo": {"period": period}}
    return [entry | ({"monthlyCondoFee": condo} if condo is not None else {})]


def page(records, number=1, status=200, origin="portal", request_id="r1", total=None) -> str:
    body = {"origin": origin, "request_id": request_id, "page": number, "status": status}
    if records is not None:
        body["search"] = {"totalCount": total or len(records), "result": {"listings": records}}
    return json.dumps(body)


def requests(spark, **changes):
    row = {"request_id": "r1", **CONTEXT, **changes}
    schema = ", ".join(f"{c} string" for c in row)
    return spark.createDataFrame([tuple(row.values())], schema)

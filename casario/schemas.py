"""Schemas of the landed documents and of the stored tables."""

# Numeric listing fields arrive as number, text or a list of either. Declared as string,
# the JSON reader keeps the literal text of whatever token it meets.
PRICING = "array<struct<businessType:string,price:string,monthlyCondoFee:string,rentalInfo:struct<period:string>>>"

ADDRESS = (
    "struct<street:string,streetNumber:string,neighborhood:string,complement:string,"
    "point:struct<lat:double,lon:double>>"
)

# Every field the portals return for a listing, in their order (fixed values).
LISTING_FIELDS = {
    "displayAddressType": "string",
    "amenities": "array<string>",
    "usableAreas": "string",
    "constructionStatus": "string",
    "listingType": "string",
    "description": "string",
    "title": "string",
    "stamps": "string",
    "createdAt": "string",
    "floors": "string",
    "unitTypes": "array<string>",
    "nonActivationReason": "string",
    "providerId": "string",
    "propertyType": "string",
    "unitSubTypes": "string",
    "unitsOnTheFloor": "string",
    "legacyId": "string",
    "id": "string",
    "portal": "string",
    "unitFloor": "string",
    "parkingSpaces": "string",
    "updatedAt": "string",
    "address": ADDRESS,
    "suites": "string",
    "publicationType": "string",
    "externalId": "string",
    "bathrooms": "string",
    "usageTypes": "string",
    "totalAreas": "string",
    "advertiserId": "string",
    "advertiserContact": "string",
    "whatsappNumber": "string",
    "bedrooms": "string",
    "acceptExchange": "string",
    "pricingInfos": PRICING,
    "showPrice": "string",
    "resale": "string",
    "buildings": "string",
    "capacityLimit": "string",
    "status": "string",
}

LISTING_STRUCT = "struct<" + ",".join(f"{n}:{t}" for n, t in LISTING_FIELDS.items()) + ">"

RECORD_FIELDS = {
    "listing": LISTING_STRUCT,
    "account": "string",
    "medias": "array<struct<url:string>>",
    "accountLink": "string",
    "link": "struct<href:string>",
}

# Search context stamped on every record; it wins over equally named record fields.
CONTEXT_FIELDS = (
    "site",
    "neighborhood",
    "locationId",
    "state",
    "city",
    "zone",
    "business_type",
    "listing_type",
    "origin",
)

RECORD_STRUCT = "struct<" + ",".join(f"{n}:{t}" for n, t in RECORD_FIELDS.items()) + ">"

# A landed page: the response body under `search`, next to what was asked for. Records stay the
# text they are, so fields that no schema names are kept.
PAGE = (
    "origin string, request_id string, page int, status int, "
    "search struct<totalCount:bigint,result:struct<listings:array<string>>>, _corrupt_record string"
)

REQUIRED = (
    "url",
    "neighborhood",
    "location_id",
    "state",
    "city",
    "zone",
    "business_type",
    "listing_type",
    "raw",
)

# Keep their first-seen value once a url is stored.
IMMUTABLE = (
    "neighborhood",
    "location_id",
    "state",
    "city",
    "zone",
    "business_type",
    "listing_type",
    "created_date",
)

# Overwritten when the change gate opens.
MUTABLE = (
    "raw",
    "title",
    "usable_area",
    "floors",
    "type_unit",
    "bedrooms",
    "bathrooms",
    "suites",
    "parking_spaces",
    "amenities",
    "images",
    "address",
    "address_lat",
    "address_lon",
    "price",
    "condo_fee",
    "total_fee",
    "linha",
    "estacao",
    "lat_metro",
    "lon_metro",
    "distance",
    "updated_date",
)

LISTING_TYPES = {
    "url": "string",
    "neighborhood": "string",
    "location_id": "string",
    "state": "string",
    "city": "string",
    "zone": "string",
    "business_type": "string",
    "listing_type": "string",
    "raw": "string",
    "title": "string",
    "usable_area": "double",
    "floors": "int",
    "type_unit": "string",
    "bedrooms": "int",
    "bathrooms": "int",
    "suites": "int",
    "parking_spaces": "int",
    "amenities": "array<string>",
    "images": "array<string>",
    "address": "string",
    "address_lat": "double",
    "address_lon": "double",
    "price": "double",
    "condo_fee": "double",
    "total_fee": "double",
    "linha": "string",
    "estacao": "string",
    "lat_metro": "double",
    "lon_metro": "double",
    "distance": "double",
    "created_date": "timestamp",
    "updated_date": "timestamp",
    "total_fee_predict": "double",
    "created": "timestamp",
    "updated": "timestamp",
}


def ddl(types: dict[str, str]) -> str:
    return ", ".join(f"{n} {t}" for n, t in types.items())


ACTIVE_TYPES = {
    "url": "string",
    "location_id": "string",
    "business_type": "string",
    "listing_type": "string",
    "updated_date": "timestamp",
}
SEGMENT = ("business_type", "listing_type", "location_id")

STATION_TYPES = {
    "linha": "string",
    "estacao": "string",
    "lat": "double",
    "lng": "double",
    "url": "string",
    "uf": "string",
}

LOCATION_KEYS = ("city", "stateAcronym", "zone", "locationId", "state", "neighborhood")

# Columns the training scan reads.
TRAINING_COLUMNS = (
    "url",
    "neighborhood",
    "usable_area",
    "floors",
    "type_unit",
    "bedrooms",
    "bathrooms",
    "suites",
    "parking_spaces",
    "amenities",
    "address_lat",
    "address_lon",
    "total_fee",
    "estacao",
    "distance",
    "created_date",
    "updated_date",
)

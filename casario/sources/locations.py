"""Directory of searchable locations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casario.functions import texts
from casario.schemas import LOCATION_KEYS

MAX_MATCHES = 6

# Accented letters and what they fold to (fixed values).
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaeeeeiiiiooooouuuucn"


def folded(name):
    return F.translate(F.lower(name), ACCENTED, PLAIN)


def named_locations(directory: DataFrame, seq: str = "seq") -> DataFrame:
    """Display name and the six address keys; the last entry of a location, then of a name, wins."""
    usable = directory.where(texts.blank_to_null(F.col("locationId")).isNotNull())
    entry = F.struct(*LOCATION_KEYS)
    per_id = usable.groupBy("locationId", "stateAcronym").agg(
        # an id keeps the place of its first entry and the content of its last
        F.min(seq).alias("_place"), F.max_by(entry, seq).alias("_a")
    )
    named = per_id.withColumn("name", texts.location_name(F.col("locationId"), F.col("stateAcronym")))
    return (
        named.groupBy("name")
        .agg(F.max_by(F.struct("_a", "_place"), "_place").alias("_b"), F.min("_place").alias("place"))
        .select("name", "place", "_b._a.*")
    )


def search_locations(directory: DataFrame, text: str, limit: int = MAX_MATCHES, seq: str = "seq") -> DataFrame:
    """At most ``limit`` directory entries whose neighbourhood contains the text, then named."""
    matches = directory.where(F.contains(folded(F.col("neighborhood")), folded(F.lit(text)))).orderBy(seq).limit(limit)
    return named_locations(matches, seq)

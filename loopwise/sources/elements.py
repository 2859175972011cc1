"""Map elements without personal fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fields and tags that may name a person.
FIELDS = ["user", "uid", "timestamp", "changeset", "version"]
TAGS = ["phone", "contact:phone", "email", "contact:email"]


def sanitized(elements: DataFrame) -> DataFrame:
    """`elements(..., tags map)` without those fields and tags; null tags stay
    null, and a second pass changes nothing."""
    return elements.drop(*FIELDS).withColumn("tags", F.map_filter("tags", lambda k, _: ~k.isin(TAGS)))


def unclean(elements: DataFrame) -> DataFrame:
    """The elements that hold a value in one of those fields or such a tag."""
    held = F.coalesce(F.arrays_overlap(F.map_keys("tags"), F.array(*map(F.lit, TAGS))), F.lit(False))
    for c in set(FIELDS) & set(elements.columns):
        held = held | F.col(c).isNotNull()
    return elements.where(held)

"""Publishing and adopting items of a shared store.

An item is published once under its content id; an adoption is one record for
each pair of adopter and item, whatever the number of requests. Requests that
cannot be met get a typed outcome, and no record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Outcomes of a request.
ADOPTED, HELD, NOT_FOUND, MALFORMED, NO_BLOB = "adopted", "held", "not_found", "malformed_record", "blob_unavailable"


class AdoptionError(Exception):
    """A request that cannot be met; ``item`` says which, the class why."""

    def __init__(self, item):
        super().__init__(f"{type(self).__name__}: {item}")
        self.item = item


class ItemNotFound(AdoptionError):
    """The store has no item of that id."""


class MalformedRecord(AdoptionError):
    """The item's record lacks what it must have."""


class BlobUnavailable(AdoptionError):
    """The item's record is there, its content is not."""


ERRORS = {NOT_FOUND: ItemNotFound, MALFORMED: MalformedRecord, NO_BLOB: BlobUnavailable}


def adoption_id(adopter: Column, item: Column) -> Column:
    """One id a pair; the form is a fixed value of the exchange format."""
    return F.concat_ws("-", F.lit("adopt"), adopter.cast("string"), item.cast("string"))


def adopt(requests: DataFrame, items: DataFrame, blobs: DataFrame, adoptions: DataFrame | None = None, needed: tuple[str, ...] = ()) -> DataFrame:
    """One row for each pair (adopter, item) of ``requests``: adoption_id and outcome.

    items: item and its record; a record is malformed if a ``needed`` column is
    null. blobs: item of every content that can be read. adoptions: adoption_id
    of what is held already.
    """
    pairs = requests.select("adopter", "item").filter("adopter IS NOT NULL").distinct()
    whole = F.lit(True)
    for c in needed:
        whole = whole & F.col(c).isNotNull()
    known = items.groupBy("item").agg(F.max(whole).alias("_whole"))
    out = pairs.join(known, "item", "left").join(blobs.select("item").distinct().withColumn("_blob", F.lit(True)), "item", "left")
    out = out.withColumn("adoption_id", adoption_id(F.col("adopter"), F.col("item")))
    held = F.lit(None).cast("boolean")
    if adoptions is not None:
        out = out.join(adoptions.select("adoption_id").distinct().withColumn("_held", F.lit(True)), "adoption_id", "left")
        held = F.col("_held")
    outcome = F.when(held, HELD).when(F.col("_whole").isNull(), NOT_FOUND).when(~F.col("_whole"), MALFORMED).when(F.col("_blob").isNull(), NO_BLOB).otherwise(ADOPTED)
    return out.select("adoption_id", "adopter", "item", outcome.alias("outcome"))


def require(outcomes: DataFrame) -> None:
    """Raise the error of the first request (by adopter, then item) that was not met."""
    first = outcomes.filter(F.col("outcome").isin(*ERRORS)).orderBy("adopter", "item").first()
    if first:
        raise ERRORS[first["outcome"]](first["item"])


def popularity(adoptions: DataFrame) -> DataFrame:
    """Adopters of each item."""
    return adoptions.groupBy("item").agg(F.countDistinct("adopter").alias("adopters"))

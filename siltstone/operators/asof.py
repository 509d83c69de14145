"""As-of joins: each row with the latest row of its key before its time, however many rows a key has."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], at: str, right_at: str, order: str, seconds: int = 86_400, inclusive: bool = False) -> DataFrame:
    """``left`` with ``columns`` of the latest ``right`` row of the same keys before ``at``; null where there is none.

    Of several rows at the latest time the one that is greatest by ``order`` counts. ``inclusive`` also takes a row of the very time.
    Names of ``columns`` are not those of ``left``; a null key or time on either side meets nothing.

    Time is cut into buckets of ``seconds``. Within a bucket both sides are laid in one order and the last right row is carried on; what
    came before a bucket is the last row of an earlier one, of which there is one a key and bucket. So no task holds more of a
    key than a bucket's rows or one row for each of its buckets: a hot key wants narrow buckets.
    """
    known = [F.col(k).isNotNull() for k in keys]
    side = F.lit(0) if inclusive else F.lit(1)  # at equal times: right rows first, or last
    found = F.struct(*[F.col(c).alias(c) for c in columns])

    def bucket(time):
        return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000))

    rows = left.withColumn("__bucket", bucket(at))
    events = right.select(*keys, F.col(right_at).alias("__time"), F.col(order).alias("__order"), found.alias("__found")).where(F.col("__time").isNotNull())
    for k in known:
        events = events.where(k)
    events = events.withColumn("__bucket", bucket("__time"))

    last = events.groupBy(*keys, "__bucket").agg(F.max_by("__found", F.struct("__time", "__order")).alias("__last"))
    asked = rows.select(*keys, "__bucket").where("__bucket is not null").distinct().withColumn("__last", F.lit(None).cast(last.schema["__last"].dataType)).withColumn("__asked", F.lit(True))
    steps = asked.unionByName(last.withColumn("__asked", F.lit(False))).groupBy(*keys, "__bucket").agg(F.first("__last", ignorenulls=True).alias("__last"), F.bool_or("__asked").alias("__asked"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("__before", F.last("__last", ignorenulls=True).over(before)).where("__asked").select(*keys, "__bucket", "__before")

    ours = rows.select(*keys, "__bucket", F.col(at).alias("__time"), F.lit(0 if not inclusive else 1).alias("__side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("__row"))
    theirs = events.select(*keys, "__bucket", "__time", side.alias("__side"), "__order", "__found")
    both = ours.unionByName(theirs, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "__bucket").orderBy("__time", "__side", "__order").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("__here", F.last("__found", ignorenulls=True).over(inside)).where("__row is not null")
    out = met.join(carried.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__bucket").alias("__b"), "__before"), [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("__bucket") == F.col("__b")], "left")
    best = F.coalesce("__here", "__before")
    none = F.col("__time").isNull()
    for k in known:
        none = none | ~k
    return out.select("__row.*", *[F.when(~none, best[c]).alias(c) for c in columns])

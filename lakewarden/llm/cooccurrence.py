"""Items that appear together: pair counts over records and how far they exceed chance.

Basket collapsing: each record's items become a sorted array without repeats; identical
arrays are grouped into one basket with a weight, so pairs are enumerated once per
distinct basket and weights are summed with map-side combine.  Popular baskets cost one
row however many records hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakewarden.sources.tables import cut


def baskets(records: DataFrame, fields: list[str]) -> DataFrame:
    """field_name, basket, weight: the distinct baskets of each array column.

    One row of ``records`` is one record.  Null and empty lists are no records; null items are
    dropped and repeated ones count once, so a list of nulls is a record without items.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("items")) for f in fields])).alias("_f")
    return (
        records.select(each)
        .select("_f.field_name", "_f.items")
        .where(F.size("items") > 0)
        .select("field_name", F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("basket"))
        .groupBy("field_name", "basket")
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def counts(collapsed: DataFrame) -> DataFrame:
    """field_name, item_a, item_b, n from baskets().

    Both items null: the number of records; only item_b null: records with item_a; else
    records with both, item_a < item_b.  Pairs are made one at a time by two generators, so
    a long basket needs no array of all its pairs.
    """
    lead = collapsed.withColumn("basket", F.concat(F.array(F.lit(None).cast("string")), "basket"))
    firsts = lead.select("field_name", "weight", "basket", F.posexplode("basket").alias("_i", "item_a"))
    nothing = F.array(F.lit(None).cast("string"))
    rest = F.when(F.col("_i") == 0, nothing).otherwise(F.concat(nothing, F.slice("basket", F.col("_i") + 2, F.size("basket"))))
    return firsts.select("field_name", "weight", "item_a", F.explode(rest).alias("item_b")).groupBy("field_name", "item_a", "item_b").agg(F.sum("weight").alias("n"))


def pairs(records: DataFrame, fields: list[str], min_count: int = 1, min_share: tuple[int, int] = (0, 1), min_lift: float = 0.0) -> DataFrame:
    """One row per field and pair of items that meet in at least ``min_count`` records.

    Columns: field_name, action_a, action_b, n_ab, n_a, n_b, n, lift, conviction (of a to b;
    null where b follows a always).  ``min_share`` is a fraction (numerator, denominator) of
    the records of the field; ``min_lift`` bounds n_ab * n / (n_a * n_b) from below.
    Comparisons are exact, in whole numbers.  An empty table gives no rows.
    """
    made = counts(baskets(records, fields))
    # Rare pairs, of which there are most, are dropped before anything is written.
    found = cut(made.where(F.col("item_b").isNull() | (F.col("n") >= min_count)))
    total = found.where(F.col("item_a").isNull()).select("field_name", F.col("n").alias("n"))
    single = found.where(F.col("item_a").isNotNull() & F.col("item_b").isNull())
    pair = found.where(F.col("item_b").isNotNull()).select("field_name", F.col("item_a").alias("action_a"), F.col("item_b").alias("action_b"), F.col("n").alias("n_ab"))
    top, bottom = min_share
    # One row per field: as many rows as the caller gave names.
    pair = pair.join(F.broadcast(total), "field_name").where(F.col("n_ab") * F.lit(bottom) >= F.col("n") * F.lit(top))
    pair = pair.join(single.select("field_name", F.col("item_a").alias("action_a"), F.col("n").alias("n_a")), ["field_name", "action_a"])
    pair = pair.join(single.select("field_name", F.col("item_a").alias("action_b"), F.col("n").alias("n_b")), ["field_name", "action_b"])
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("n_ab", "n", "n_a", "n_b")}
    enough = wide["n_ab"] * wide["n"] >= wide["n_a"] * wide["n_b"] * F.lit(str(min_lift)).cast("decimal(10,4)")
    ab, n, a, b = (F.col(c).cast("double") for c in ("n_ab", "n", "n_a", "n_b"))
    return pair.where(enough).select(
        "field_name", "action_a", "action_b", "n_ab", "n_a", "n_b", "n",
        (ab * n / (a * b)).alias("lift"),
        F.when(ab < a, (1 - b / n) / (1 - ab / a)).alias("conviction"),
    )

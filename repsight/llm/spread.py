"""A left join whose rows may hang on few keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this part of all rows is joined by broadcast; so at most this many keys are.
HOT_KEYS = 1024


def left_join_spread(rows: DataFrame, keys: DataFrame, on: Sequence[str], n_rows: int) -> DataFrame:
    """``rows`` left-joined with ``keys`` (unique in ``on``, with a column ``n``: the key's rows).

    Keys that hold over 1/1024 of the ``n_rows`` rows are broadcast: there are
    at most 1,024 of them, and together they are no longer than 1,024 mean rows.
    Their rows are found without a shuffle by key and then dealt evenly over
    the partitions of the other keys' join. Both sides' key columns must not be
    null. The other keys always meet their rows in a sort-merge join, so the work
    keeps its kind as the tables grow. Result: the columns of ``rows``, then those of ``keys`` outside ``on``.
    """
    values = [c for c in keys.columns if c not in on]
    limit = max(n_rows // HOT_KEYS, 1)
    hot = keys.filter(F.col("n") > limit).select(*[F.col(c).alias(f"__h_{c}") for c in keys.columns])
    cold = keys.filter(F.col("n") <= limit).select(F.lit(-1).alias("__c_deal"), *[F.col(c).alias(f"__c_{c}") for c in keys.columns])
    # dealt anew by the whole join key: a side that is already dealt by ``on`` alone would draw all hot rows to one place
    cold = cold.repartition("__c_deal", *[f"__c_{c}" for c in on])
    met = rows.join(F.broadcast(hot), [F.col(c) == F.col(f"__h_{c}") for c in on], "left")
    # a hot row's place is drawn from the seeded generator of its partition, the same in a repeated task
    met = met.withColumn("__deal", F.when(F.col("__h_n").isNull(), F.lit(-1)).otherwise((F.rand(11) * (1 << 20)).cast("int")))
    joined = met.join(cold.hint("merge"), [F.col("__deal") == F.col("__c_deal"), *[F.col(c) == F.col(f"__c_{c}") for c in on]], "left")
    return joined.select(*rows.columns, *[F.coalesce(f"__h_{c}", f"__c_{c}").alias(c) for c in values])

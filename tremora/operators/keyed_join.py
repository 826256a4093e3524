"""Left join of events to a table of distinct keys, safe against hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremora.operators.numbering import WEIGHT, NumberedKeys

MAX_HOT_KEYS = 10_000
MAX_KEY_BYTES = 1_000
SPREAD = 65_536


def attach_id(
    rows: DataFrame,
    numbered: NumberedKeys,
    spread_by: str = "event_id",
    max_hot_keys: int = MAX_HOT_KEYS,
) -> DataFrame:
    """Each row with the id of its key, null where the key has none.

    Spark broadcasts the keys when they are small and shuffles both sides when
    they are not.  In a shuffle, a key that is carried by very many rows would
    fill one task.  A key counts as hot if it has at least one in ``max_hot_keys``
    of all rows, so there are at most that many; with texts of at most
    ``MAX_KEY_BYTES`` together, that is 10 MB, and they can be broadcast.  Rows of
    hot keys take their id from that broadcast, and pass the shuffle spread out by
    ``spread_by``.  Rows of other keys are joined as they are; there, a hot key of
    longer texts is left to the skew handling of adaptive execution.
    """
    keys, id_name = list(numbered.keys), numbered.id_name
    hot_from = max(1, -(-numbered.total // max_hot_keys))
    texts = [name for name, kind in numbered.rows.select(*keys).dtypes if kind == "string"]
    n_bytes = sum((F.coalesce(F.octet_length(name), F.lit(0)) for name in texts), F.lit(0))
    is_hot = (F.col(WEIGHT) >= hot_from) & (n_bytes <= MAX_KEY_BYTES)
    hot = numbered.rows.where(is_hot).select(*keys, F.col(id_name).alias("_hot_id"))
    # No row has share -1, so hot keys take no part in the shuffled join.
    others = numbered.rows.select(
        *keys, id_name, F.when(is_hot, F.lit(-1)).otherwise(F.lit(0)).alias("_share")
    )
    share = F.when(F.col("_hot_id").isNull(), 0).otherwise(
        F.pmod(F.xxhash64(spread_by), F.lit(SPREAD)).cast("int") + 1
    )
    return (
        rows.join(F.broadcast(hot), keys, "left")
        .withColumn("_share", share)
        .join(others, [*keys, "_share"], "left")
        .withColumn(id_name, F.coalesce("_hot_id", id_name))
        .drop("_hot_id", "_share")
    )

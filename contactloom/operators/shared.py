"""Helpers several operators share: lineage cuts, hot-key joins and bounded broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_MIN_ROWS = 100_000
HOT_MIN_BYTES = 16 * 1024 * 1024
HOT_SHARE = 1 / 1000
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors see: ``spark.checkpoint.dir``, or one in the warehouse if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/contactloom-work"


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the shared folder, so that later jobs do not recompute the lineage."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def by_work(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions in the configured number. Adaptive execution merges partitions by bytes; for
    short rows that cost much work each, that would leave most cores idle."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def fits_broadcast(df: DataFrame, *columns: str) -> bool:
    """Measured test of rows and bytes, so nothing that grows with the data is broadcast blindly."""
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def is_small(df: DataFrame) -> bool:
    """By the optimizer's size estimate; good enough to skip work that only pays on large inputs."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return estimate < HOT_MIN_BYTES


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    min_rows: int = HOT_MIN_ROWS,
    share: float = HOT_SHARE,
) -> DataFrame | None:
    """Keys that hold more than ``share`` of the rows: at most ``1 / share`` of them exist.

    None if the input is too small for hot keys to matter.
    """
    if min_rows >= HOT_MIN_ROWS and is_small(df):
        return None
    total = df.count()
    if total <= min_rows:
        return None
    counts = df.groupBy(*keys).count()
    return cut(counts.filter(F.col("count") > max(min_rows, total * share)).select(*keys))


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    min_rows: int = HOT_MIN_ROWS,
    share: float = HOT_SHARE,
    costly: bool = False,
) -> DataFrame:
    """Join to a side that is unique on ``keys`` when keys of the other side may be hot.

    Rows of hot keys meet a broadcast of at most ``1 / share`` right rows and are not shuffled;
    all other rows take the ordinary join. The union of both is the whole result. A large left side
    is read several times; if it is ``costly`` to compute it is written once before that.
    """
    keys = list(keys)
    if costly and not is_small(left):
        left = cut(left)
    hot = hot_keys(left.dropna(subset=keys), keys, min_rows, share)
    if hot is None:
        return left.join(right, keys, how)
    flagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    is_hot = F.coalesce(F.col("_hot"), F.lit(False))
    hot_left = flagged.filter(is_hot).drop("_hot")
    cold_left = flagged.filter(~is_hot).drop("_hot")
    hot_right = right.join(F.broadcast(hot), keys, "left_semi")
    return hot_left.join(F.broadcast(hot_right), keys, how).unionByName(
        cold_left.join(right, keys, how)
    )


#: Beyond the broadcast bound, pages are pruned by a blocked Bloom filter: so many bitmaps of
#: BITMAP_BITS bits (4 KiB each), a fixed size whatever the number of keys; FILTER_HASHES bits a key.
FILTER_BITMAPS = 1024
FILTER_HASHES = 3
BITMAP_BITS = 32768


def _filter_bits(key: Column) -> tuple[Column, list[Column]]:
    """The bitmap of a key and its bit positions inside that bitmap."""
    bitmap = F.pmod(F.xxhash64(key), F.lit(FILTER_BITMAPS))
    return bitmap, [F.pmod(F.xxhash64(key, F.lit(n + 1)), F.lit(BITMAP_BITS)) for n in range(FILTER_HASHES)]


def key_filter(wanted: DataFrame, column: str) -> DataFrame:
    """``_bitmap_no, _bitmap``: a blocked Bloom filter of the keys, built by native bitmap aggregates.

    At most FILTER_BITMAPS rows of 4 KiB, so it is broadcast whatever the size of ``wanted``.
    """
    number, bits = _filter_bits(F.col(column))
    positions = wanted.select(number.alias("_bitmap_no"), F.explode(F.array(*bits)).alias("_bit"))
    return positions.groupBy("_bitmap_no").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))


def _bit_set(bitmap: Column, bit: Column) -> Column:
    """Whether bit ``bit`` of a bitmap is set (bit b lives in byte b div 8, at place b mod 8)."""
    byte = F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return value.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0


def might_be_wanted(df: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Rows whose key may be in the filter ``keys``; no wanted row is dropped, a few others pass."""
    number, bits = _filter_bits(key)
    probed = df.withColumn("_bitmap_no", number).join(F.broadcast(keys), "_bitmap_no")
    test = F.lit(True)
    for bit in bits:
        test = test & _bit_set(F.col("_bitmap"), bit)
    return probed.filter(test).drop("_bitmap_no", "_bitmap")


def restrict_to(df: DataFrame, key: Column, wanted: DataFrame, column: str) -> DataFrame:
    """Keep rows whose key is wanted, and at most a small share of others, before costly parsing.

    Few wanted keys are broadcast and matched exactly. More are summarised in a Bloom filter of
    fixed size, which lets through every wanted row and a share of the others that grows with the
    number of keys; the caller joins on the key anyway, after reducing wide rows to narrow ones, so
    page bodies are never shuffled and the result is exact at every size.
    """
    if not fits_broadcast(wanted, column):
        return might_be_wanted(df, key, key_filter(wanted, column))
    return (
        df.withColumn("_key", key)
        .join(F.broadcast(wanted.select(F.col(column).alias("_key")).distinct()), "_key", "left_semi")
        .drop("_key")
    )

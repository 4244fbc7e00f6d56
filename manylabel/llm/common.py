"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract here: blank and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it differ from all column names that are ``taken`` (Spark ignores case)."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        name = f"__{name}"
        while name.lower() in held:
            name = f"_{name}"
        held.add(name.lower())
        out.append(name)
    return out


#: Bits of a filter of ids: 16 for each, up to 32 MB in all.
MIN_ID_BITS, MAX_ID_BITS, _BITMAP = 1 << 20, 1 << 28, 1 << 15


def flagged(d: DataFrame, id_: Column, ids: DataFrame, n: int, flag: str) -> DataFrame:
    """``d`` in place with a boolean ``flag``: false only where the id is not among the ``n`` (about) ``ids`` (one column).

    The filter is made of Spark's bitmaps: as many bits as 16 times the ids, with the bound above, so it can be broadcast whatever
    their number. Beyond 16 million ids it lets more through, and beyond a billion nearly all.
    """
    bits = min(MAX_ID_BITS, max(MIN_ID_BITS, 1 << (16 * max(n, 1) - 1).bit_length()))
    block, maps = unused(d.columns, "block", "bits")
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(bits))
    at = place(ids[ids.columns[0]])
    held = ids.groupBy(F.floor(at / _BITMAP).alias(block)).agg(F.bitmap_construct_agg((at % _BITMAP).cast("long")).alias(maps))
    at = place(id_)
    byte = F.conv(F.hex(F.substring(F.col(maps), (F.floor(at % _BITMAP / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    d = d.join(F.broadcast(held), F.floor(at / _BITMAP) == F.col(block), "left")
    return d.withColumn(flag, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(block, maps)


def ascii_lower(c: Column) -> Column:
    """Only A-Z change, whatever the locale or script."""
    return F.translate(c, UPPER, LOWER)


def _shared_folder(spark: SparkSession) -> str:
    """The run's folder inside the one that the session names in ``spark.checkpoint.dir``.

    Only where that is unset and all runs on one machine (tests) is it a folder of our own. What earlier steps
    shuffled and nobody refers to any more is given free first: Spark deletes shuffle files
    when the driver's garbage is collected, which a driver with little work may not do for long.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "checkpoints"))
    gc.collect()
    sc._jvm.System.gc()
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Rows written once to the shared checkpoint folder, so that later jobs neither recompute them nor depend on one executor."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`checkpointed` for large results: a compressed table in the same folder, of which later jobs read only what they need."""
    return written(df)[0]


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """As :func:`stored`, with the table's path."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def emptied(df: DataFrame, path: str) -> None:
    """Frees the room of a table of :func:`written` that nobody reads any more."""
    df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)

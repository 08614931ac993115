"""What several of the text operators share: materialised intermediates, checked broadcasts, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it was counted and has at most this many rows.
BROADCAST_ROWS = 50_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the one that the cluster shares. Only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/wakeline-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    delete_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Let the driver delete a folder when its session ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def spare(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores behind them where columns are called so already (in whatever case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def drop_materialised(df: DataFrame) -> None:
    """Delete the folder of a frame made by `materialise` that no later step reads."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checked_join(big: DataFrame, small: DataFrame, on: list[str] | Column | str, how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast `small` if a count shows that it has at most `max_rows` rows; else shuffle, and adaptive
    execution splits the hot keys. `small` should be cheap to read again, such as a materialised table."""
    fits = small.limit(max_rows + 1).count() <= max_rows
    return big.join(F.broadcast(small) if fits else small.hint("merge"), on, how)


class WordHash(dict):
    """A cache of 64-bit hashes of words; emptied when it has grown large."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words; of the whole where there are fewer; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        h = mix(h) * _MULT + words[i : len(words) - n + 1 + i]
    return mix(h)

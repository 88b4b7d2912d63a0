"""Helpers that the corpus operators share: word hashing, Arrow batch plumbing, bounded broadcasts, lineage cuts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder

#: Documents handled at once inside a Python worker; bounds its memory, not the result.
SLICE = 512
#: Entries of a per-worker memo; a full memo is emptied, so this bounds memory and never changes a result.
MEMO = 200_000


class Memo(dict):
    """A dict that computes what it misses and starts afresh when full."""

    def __init__(self, compute: Callable, limit: int = MEMO):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def word_hashes(limit: int = MEMO) -> Memo:
    """Word -> 64-bit hash, the same in every process."""
    return Memo(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), limit)


def words_of(text: str | None) -> list[str]:
    """Lower-cased words between white space; none of a null text."""
    return text.lower().split() if text else []


def hashed(words: list[str], memo: Memo) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


_MUL, _FIN1, _FIN2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that the order of the hashes is as good as random."""
    h = (h ^ (h >> np.uint64(30))) * _FIN1
    h = (h ^ (h >> np.uint64(27))) * _FIN2
    return h ^ (h >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams in order; of fewer than n words, the one gram that they are; none of no words."""
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * _MUL + h[i : i + len(out)]
    return mixed(out)


#: Rows of a batch that goes to Python; Spark's default of 10,000 texts would be tens of MB in the JVM and again in Python.
BATCH_ROWS = 1024


def lean(df: DataFrame) -> DataFrame:
    """df, after seeing to it that its texts go to Python in small batches, unless the session names a number of its own."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key) == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE) -> Iterator[dict[str, list]]:
    """Column lists of at most so many rows, from Arrow batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, into the shared checkpoint folder, which the loss of an executor leaves whole."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, for what would be large as a checkpoint.  It goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    df.write.parquet(path)
    return spark.read.parquet(path)


#: A side is broadcast up to so many rows of a long or two (some 32 MB); beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcasting only if its rows, counted, are few enough."""
    return F.broadcast(df) if df.count() <= limit else df


#: Bytes of Parquet for each of which operators that sort a shuffle partition in Python make a partition at least.
WIDTH_BYTES = 16 << 20


def shuffle_width(df: DataFrame) -> int:
    """Shuffle partitions for what is made of df: as many as the session sets, or more if the input asks for them."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    needed = size // WIDTH_BYTES if size < 1 << 52 else 0  # a plan without statistics claims more than that
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), needed)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is so small that its files make fewer tasks than that; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import hashlib
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words in every contract: space and U+0009 to U+000D.
SPACE = r"[ \t-\r]+"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: Column) -> Column:
    """Words of a text (null: none) as an array, without a user function."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that df does not use."""
    out = []
    for n in names:
        while n.lower() in {c.lower() for c in df.columns}:
            n = "_" + n
        out.append(n)
    return out


def shared_root(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a folder of the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        warehouse = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
        root = warehouse.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(warehouse).toString() + "/_scratch"
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive lost executors and are deleted when the application ends."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
        path, fs = self._path(self.base)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def save(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        path, fs = self._path(f"{self.base}/{name}")
        fs.delete(path, True)


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts, counted: the size that numbers of blocks and buckets follow. It never changes a result."""
    return df.agg(F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0))).first()[0]


def spare_memory() -> None:
    """Gives back what the allocators of this worker keep of freed memory: it stands beside the JVM's, and idle workers keep theirs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words whose hashes a worker remembers at most; beyond it the memory starts anew.
REMEMBERED = 250_000
_HASHES: dict[bytes, int] = {}


def words_in(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of the texts (A-Z lowered), the place in that list of every word in order, and how many words each text has.

    Words are told apart by their bytes. Null texts have none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = split.flatten(), split.offsets.to_numpy()
    real = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    counts = np.diff(np.r_[0, np.cumsum(real)][ends - ends[0]])
    if not real.all():
        flat = flat.filter(pa.array(real))
    coded = flat.dictionary_encode()
    return coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy().astype(np.int64), counts.astype(np.int64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit cryptographic hash of each word."""
    known = _HASHES
    if len(known) > REMEMBERED:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        out.append(h)
    return np.array(out, np.uint64)

"""What several text operators share: typed inputs, word caches, rolling hashes, shared-folder tables."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The six ASCII white-space characters, \x20 and \x09-\x0D: what ``bytes.split()`` splits on.
SPACE = b" \t\n\v\f\r"
MIX = np.uint64(0x9E3779B97F4A7C15)
#: A task sends on what it has made of so many characters, so that results of a whole batch of long texts aren't held.
SENT_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns of fixed names and types, so that no other column of the input can clash with ours."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


#: Folders of the tables that this process has stored.
WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a session of one machine, as in
    tests, gets a temporary one; on a cluster that is an error, since executors wouldn't see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Remove what this process has stored, once nothing is read from it any more; how many tables that were."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while WRITTEN:
        at = jvm.org.apache.hadoop.fs.Path(WRITTEN.pop())
        n += bool(at.getFileSystem(conf).delete(at, True))
    return n


class WordHash(dict):
    """64-bit hash of each word, remembered up to ``most`` words."""

    def __init__(self, most: int = 100_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scramble(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def rolling(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes; empty if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= MIX
        h += words[j : j + n]
    return scramble(h)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> Iterator[str]:
    """The column's strings one by one (null: None), so that a batch of long texts isn't held twice."""
    for value in batch.column(batch.schema.get_field_index(column)):
        yield value.as_py()


def per_row(docs: DataFrame, make: Callable[[], Callable[[str | None], tuple]], fields: list[tuple[str, T.DataType]], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``docs``' columns ``keep`` and, for each row, the values that ``make()(text)`` returns; ``make`` runs once a task."""

    def make_group():
        of = make()
        return lambda texts: [of(text) for text in texts]

    return per_group(docs, make_group, fields, keep, chars=0)


def per_group(docs: DataFrame, make: Callable[[], Callable[[list], list[tuple]]], fields: list[tuple[str, T.DataType]], keep: tuple[str, ...] = ("doc_id",), chars: int = 1 << 20) -> DataFrame:
    """As ``per_row``, but ``make()(texts)`` takes neighbouring texts of about ``chars`` characters in all, or one that is longer.

    Results are sent on in batches of about ``SENT_CHARS`` characters of text, in the order of the rows."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(n, t) for n, t in fields])
    kinds = [pa_type(t) for _, t in fields]
    names = [*keep, *(n for n, _ in fields)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = make()
        for batch in batches:
            columns: list[list] = [[] for _ in kinds]
            part: list[str | None] = []
            size = first = held = 0
            for i, text in enumerate(texts_of(batch)):
                part.append(text)
                size += len(text or "")
                last = i == batch.num_rows - 1
                if size >= chars or last:
                    for values in of(part):
                        for column, value in zip(columns, values, strict=True):
                            column.append(value)
                    held += size
                    part, size = [], 0
                    if held >= SENT_CHARS or last:
                        kept = [batch.column(batch.schema.get_field_index(c)).slice(first, i + 1 - first) for c in keep]
                        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                        columns = [[] for _ in kinds]
                        yield pa.RecordBatch.from_arrays([*kept, *made], names)
                        first, held = i + 1, 0
                        del kept, made
            del batch  # else it is held while the next one is read

    return docs.mapInArrow(run, schema)


def pa_type(t: T.DataType) -> pa.DataType:
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(), T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary()}[type(t)]


def grouped(items: Iterable, size: int) -> Iterator[list]:
    it = iter(items)
    while part := list(itertools.islice(it, size)):
        yield part

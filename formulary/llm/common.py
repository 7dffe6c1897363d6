"""What the operators of this subpackage share: word rules, folds, tables that cut lineage."""

from __future__ import annotations

import random
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: The white space that ends a word, for Java and DuckDB patterns. bytes.split() cuts at the same six characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_words(text: str | None, lower: bool = False) -> list[bytes]:
    """The words of a text as UTF-8; none for a null."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def fold(column: Column, of: int) -> Column:
    """crc32 of an id as text, modulo a number; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % of


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def give_back() -> None:
    """Gives memory that is free back to the system: Python workers are used again and would keep it beside what the next task needs."""
    import ctypes

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives memory back when it ends."""

    def tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def per_text(docs: DataFrame, id_col: str, text_col: str, start: Callable[[], Callable[[list], list]], fields: str) -> DataFrame:
    """(doc_id, *fields): one row per row of docs. start() is called once a task and gives a function from texts to the fields' columns.

    Ids stay in Arrow and are handed on untouched: as pandas columns a null among them would turn them all into floats.
    """
    schema = to_arrow_schema(StructType.fromDDL("doc_id long, " + fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for b in batches:
            made = make(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(made, list(schema)[1:], strict=True))], schema=schema)

    small_batches(docs.sparkSession)
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))
    return read.mapInArrow(tidied(run), "doc_id long, " + fields)


#: Bytes of a batch of rows that goes to Python, and Spark's own bound, which a session that asks for another one doesn't have.
BATCH_BYTES, USUAL_BYTES = 8 << 20, 64 << 20


def small_batches(spark: SparkSession) -> None:
    """Long texts and arrays go to Python few at a time: a worker holds a batch several times over. A bound that the session sets stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).rstrip("b") == str(USUAL_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none gets one of our own: elsewhere it would be a folder of the driver alone."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="formulary-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: For each scratch() that is open, the tables stored in it.
_OPEN: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows, written once to the shared folder and read again: their lineage ends here, so a lost executor costs no recomputation. What nobody deletes before goes when the driver ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/formulary-{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(df: DataFrame | None) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    path = getattr(df, "_stored_at", None)
    if path:
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end, also after an error, the tables that were stored within."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """stored(make()); the tables that make() stored on its way are deleted."""
    with scratch(spark):
        out = stored(make(), name)
        _OPEN[-1].remove(out._stored_at)
    if _OPEN:
        _OPEN[-1].append(out._stored_at)
    return out


def keyed(docs: DataFrame, into: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with a whole number that tells rows apart, to link, order and join by: the id where it has one row.

    Of rows that share an id one, by the hash of its text, has the id; the others, and rows without an
    id, come after all ids. Where 64 bits have no room for them there they come before all ids, and
    where they have none there either, in a stretch that no id is in. Only where there are such rows is
    a copy of docs stored, which fixes their numbers.
    """
    own = docs.where(F.col(id_col).isNotNull())
    shared = own.groupBy(id_col).count().where("count > 1").limit(1).count()
    lacking = docs.where(F.col(id_col).isNull())
    if not shared and not lacking.limit(1).count():
        return docs.withColumn(into, F.col(id_col).cast("long"))
    at = fresh(docs.withColumn(into, F.lit(0)), "_at")
    rows = stored(docs.withColumn(at, F.monotonically_increasing_id()), "keyed")
    pick = F.min(F.struct(F.xxhash64(text_col).alias("hash"), F.col(at).alias("at")))["at"]
    first = rows.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(into)).agg(pick.alias("first"))
    first = first.select(F.col("first").alias(at), into)  # of a hot id, one row joins
    odd = F.lit(_room(own.select(F.col(id_col).cast("long").alias("id")), 1 + rows.agg(F.max(at)).first()[0])).cast("long") + F.col(at)
    return rows.join(first, at, "left").withColumn(into, F.coalesce(F.col(into).cast("long"), odd)).select(*docs.columns, into)


def _room(ids: DataFrame, n: int) -> int:
    """Where n whole numbers in a row begin that no id has: past the ids, else before them, else between."""
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    least, most = -(1 << 63), (1 << 63) - 1
    if high is None or high + n <= most:
        return 0 if high is None else high + 1
    if low - n >= least:
        return low - n
    draw = random.Random(0)
    while True:
        tries = [draw.randrange(least, most - n) for _ in range(64)]
        taken = ids.agg(*(F.count_if(F.col("id").between(t, t + n)).alias(str(k)) for k, t in enumerate(tries))).first()
        for t, k in zip(tries, taken, strict=True):
            if not k:
                return t


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (shift, multiply), for hashes made from sums."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Rolling:
    """64-bit hashes of words and of runs of words, a whole batch of texts at a time."""

    BASE, STEP = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1

    def __init__(self) -> None:
        self._byte = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        self._space = np.zeros(256, bool)
        self._space[[0x20, *range(0x09, 0x0E)]] = True
        self._powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _power(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        got = self._powers.get(base)
        if got is None or len(got[0]) < n:
            size = max(n, 1 << 16)
            up, down = (np.full(size, b, np.uint64) for b in (base, pow(base, -1, 1 << 64)))
            up[0] = down[0] = 1
            got = self._powers[base] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        return got

    def words(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and end of every word."""
        data = np.frombuffer(raw, np.uint8)
        if not len(data):
            none = np.empty(0, np.int64)
            return np.empty(0, np.uint64), none, none
        inside = np.concatenate(([False], ~self._space[data], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        up, down = self._power(self.BASE, len(data))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self._byte[data] * up[: len(data)], dtype=np.uint64)))
        return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start, end

    def runs(self, words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
        """Hash of every run of so many words. Two salts give two independent hashes."""
        n = len(words) - length + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        up, down = self._power(self.STEP, len(words))
        if salt:
            words = mix64(words + np.uint64(salt))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))
        return mix64((total[length:] - total[:n]) * down[:n])

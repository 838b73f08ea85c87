"""Shared helpers: shared folders, batches of bounded size, and byte-range hashes in numpy."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.cut import shared_base

#: Rows of an Arrow batch at most: long texts keep a batch at a few MB.
BATCH_ROWS = 500
#: Bytes of text handled at once by the numpy helpers (a longer text is handled alone).
BLOCK_BYTES = 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """A new folder name in ``spark.checkpoint.dir``, kept for the session; unset, it is an error on a cluster."""
    base = shared_base(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


#: Shuffle files go when the query that made them ends, not when the driver next collects its garbage.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lost executors cost nothing, and its size is known.

    Nothing reads the shuffles of the write again, so they are deleted with it.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    before = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what came of them is itself stored."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the rows of an Arrow batch to ``rows``; a smaller setting of the session is kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and its n + 1 offsets; a null counts as an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_string()).fill_null("")
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of ``limit`` bytes at most, or of one text."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, last
        first = last


def give_back() -> None:
    """Return freed memory to the system: workers keep what they have while they wait between tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def released(batches: Iterator) -> Iterator:
    """The same batches; afterwards freed memory goes back to the system."""
    try:
        yield from batches
    finally:
        give_back()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class RangeHash:
    """64-bit hashes of many byte ranges at once, from running sums of a polynomial over the bytes.

    Equal bytes have equal hashes, but different bytes can be made up that have them too: for
    choosing places and partitions only.  ``PrimeHash`` tells byte ranges apart.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 0):
        self.of_byte = mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * seed))
        self.power = np.ones(1, np.uint64)
        self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.power) < n:
            n = -(-n // 65536) * 65536
            back = pow(self.BASE, -1, 1 << 64)
            for name, step in (("power", self.BASE), ("inverse", back)):
                factors = np.full(n, step, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
        self._reach(len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.of_byte[data] * self.power[: len(data)], out=sums[1:])
        h = (sums[ends] - sums[starts]) * self.inverse[starts]
        return mixed(h + mixed((ends - starts).astype(np.uint64)))


class PrimeHash:
    """62-bit hashes of many byte ranges at once, by which ranges are told apart.

    Two polynomials over the prime 2^31 - 1 with bases of their own: two different ranges of n
    bytes agree in both with a probability of about (n / 2^31)^2, whatever they hold.
    """

    PRIME = (1 << 31) - 1
    # Two bases below the prime.
    BASES = (1_812_433_253, 1_566_083_941)

    def __init__(self, seed: int = 0):
        codes = mixed(np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * seed + 500))
        self.of_byte = [self._fold(codes >> np.uint64(s)) for s in (1, 33)]
        self.power = [np.ones(1, np.uint64) for _ in self.BASES]
        self.inverse = [np.ones(1, np.uint64) for _ in self.BASES]

    @classmethod
    def _fold(cls, x: np.ndarray) -> np.ndarray:
        """Remainders by the prime, of numbers below 2^63."""
        p, bits = np.uint64(cls.PRIME), np.uint64(31)
        for _ in range(2):
            x = (x & p) + (x >> bits)
        x = (x & p) + (x >> bits)
        return np.where(x == p, np.uint64(0), x)

    def _reach(self, n: int) -> None:
        for powers, bases in ((self.power, self.BASES), (self.inverse, [pow(b, -1, self.PRIME) for b in self.BASES])):
            for i, base in enumerate(bases):
                while len(powers[i]) < n:
                    step = np.uint64(pow(base, len(powers[i]), self.PRIME))
                    powers[i] = np.concatenate([powers[i], self._fold(powers[i] * step)])

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
        self._reach(len(data) + 1)
        h = mixed((ends - starts).astype(np.uint64))
        for of_byte, power, inverse in zip(self.of_byte, self.power, self.inverse):
            sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(self._fold(of_byte[data] * power[: len(data)]), out=sums[1:])
            own = self._fold(self._fold(sums[ends] - sums[starts]) * inverse[starts])
            h = mixed((h << np.uint64(1)) ^ h >> np.uint64(40) ^ own * np.uint64(0x9E3779B97F4A7C15))
        return h


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of every range, one range after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts.astype(np.int64) - before, lengths) + np.arange(total, dtype=np.int64)


def packed_rows(docs: DataFrame, *used: str) -> DataFrame:
    """The whole row as one struct, ``__row``, beside the columns that an operator reads.

    A filter over it may add columns of any name: none can clash with the row's own.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[F.col(f"`{c}`") for c in used])


def unpacked_rows(rows: DataFrame) -> DataFrame:
    return rows.select("__row.*")


#: Bits of an id filter: 4 MB, whatever the number of ids.
FILTER_BITS = 1 << 25


def id_filter(keys: DataFrame, key: str) -> Callable[[Column], Column]:
    """A test that is true for every value of ``key`` (64-bit hashes), and false for most others.

    One bit per value in a table of FILTER_BITS bits, gathered as at most FILTER_BITS / 64 words.
    With very many values it lets everything pass: it saves work and decides nothing.
    """
    bit = F.pmod(F.col(key), F.lit(FILTER_BITS))
    words = (
        keys.select(F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(64)).cast("int")).alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    table = np.zeros(FILTER_BITS // 64, np.int64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy()
    held = keys.sparkSession.sparkContext.broadcast(table)

    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            at = batch.to_numpy() & (FILTER_BITS - 1)
            yield pa.array((held.value[at >> 6] >> (at & 63)) & 1 == 1)

    return F.arrow_udf(look, "boolean")

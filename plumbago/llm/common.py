"""Shared pieces: scratch tables, Arrow text batches, vectorised word hashing."""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from plumbago.runtime import scratch, ship

#: Bytes of `[\x20\x09-\x0D]`, the characters that separate words.
SPACES = b" \t\n\x0b\x0c\r"
#: Texts are handled in slices of about so many bytes inside a task, so that a
#: task's memory does not depend on how many rows an Arrow batch has.
SLICE_BYTES = 1 << 20
#: Rows and bytes of one Arrow batch between the JVM and Python, at most.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

_MASK = (1 << 64) - 1


def tune(spark: SparkSession) -> None:
    """The package on the workers, and Arrow batches bounded by rows and bytes, as a batch of long texts is held in memory whole."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Rows of a file of a scratch table whose number of rows is known before it is written.
FILE_ROWS = 100_000


def table(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts the lineage there.

    rows: at most about so many rows are in it. Then there are no more tasks, and so files, than one for FILE_ROWS
    rows, or one a core: each file is made with calls of its own to the file system (on a local one, processes).
    """
    spark = df.sparkSession
    path = scratch(spark, "table")
    some = df if rows is None else df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    some.write.option("compression", "snappy").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by `table` that nothing not yet computed reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of df has (letter case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(column: str):
    """The column of just that name, dots and all."""
    from pyspark.sql import functions as F

    return F.col("`" + column.replace("`", "``") + "`")


def _allocator():
    """The C library's call that gives freed memory back, where it has one; few heaps for threads."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(-8, 2)
        return libc.malloc_trim
    except (AttributeError, OSError):
        return lambda pad: 0


_trim, _trimmed = None, 0.0


def give_back(seconds: float = 2.0) -> None:
    """Freed memory goes back to the system, every so many seconds, as Python workers are used again by other jobs."""
    global _trim, _trimmed
    if _trim is None:
        _trim = _allocator()
    if time.monotonic() - _trimmed > seconds:
        pa.default_memory_pool().release_unused()
        _trim(0)
        _trimmed = time.monotonic()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLICE_BYTES together; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > SLICE_BYTES:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def text_udf(fn: Callable, out: str, spark: SparkSession):
    """An Arrow function of a text column: a struct of what `fn(list of bytes) -> dict of lists or arrays` makes of each slice of texts.

    Only the texts go to Python and only the struct comes back; the other
    columns of a row stay in the JVM.
    """
    from pyspark.sql import functions as F

    schema = spark.createDataFrame([], out).schema
    arrow = [(f.name, _arrow_type(f)) for f in schema]
    kind = pa.struct([pa.field(n, t) for n, t in arrow])

    def run(column: pa.Array) -> pa.Array:
        texts, parts = texts_of(column), []
        for a, b in slices(texts):
            got = fn(texts[a:b])
            parts.append(pa.StructArray.from_arrays([pa.array(got[n], t) for n, t in arrow], [n for n, _ in arrow]))
        out = pa.concat_arrays(parts) if parts else pa.array([], kind)
        give_back()
        return out

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, schema)


def with_text(df: DataFrame, fn: Callable, out: str, *, text: str, name: str) -> DataFrame:
    """df and a struct column `name` of what `fn` makes of each text; see text_udf."""
    return df.withColumn(name, text_udf(fn, out, df.sparkSession)(named(text).cast("string")))


def per_text(df: DataFrame, fn: Callable, out: str, *, text: str, keep: list[str]) -> DataFrame:
    """Columns `keep` of df, then those that `fn` makes of each text (DDL `out`); see text_udf."""
    made = df.sparkSession.createDataFrame([], out).schema.names
    name = fresh(df, "__made")
    return with_text(df, fn, out, text=text, name=name).select(*[named(k) for k in keep], *[named(name)[n].alias(n) for n in made])


def schema_with(df: DataFrame, keep: list[str], ddl: str):
    """The schema of df's columns `keep`, then the columns of a DDL string."""
    from pyspark.sql.types import StructType

    fields = {f.name: f for f in df.schema.fields}
    return StructType([*(fields[k] for k in keep), *df.sparkSession.createDataFrame([], ddl).schema.fields])


def _arrow_type(field) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


# -- hashing of words, vectorised over a whole slice --------------------------


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes modulo 2**64 of any spans of a sequence, by prefix sums.

    The base is odd, so it has an inverse: the hash of a span is the difference
    of two prefix sums times the inverse power of its start.
    """

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(values)
        if n > len(self.up):
            size = 1 << n.bit_length()
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts])


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit over the whole word (a bijection)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def byte_class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(members)] = True
    return out


IS_SPACE = byte_class(SPACES)
#: Words of more bytes are hashed one by one.
LONG_WORD = 512
_SIZE_HASH = mix(np.arange(LONG_WORD + 1, dtype=np.uint64) * np.uint64(0xFF51AFD7ED558CCD))
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each byte span: eight bytes at a time, multiplied and shifted in turn, so that no two spans' differences cancel."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    size = ends - starts
    h = _SIZE_HASH[np.minimum(size, LONG_WORD)] ^ np.uint64(seed)

    def absorbed(h, chunk):
        x = (h ^ chunk) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x * np.uint64(0xC4CEB9FE1A85EC53)

    h = absorbed(h, eight[starts] & _LOW_BYTES[np.minimum(size, 8)])
    todo, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(todo):
        h[todo] = absorbed(h[todo], eight[starts[todo] + at] & _LOW_BYTES[np.minimum(size[todo] - at, 8)])
        at += 8
        todo = todo[size[todo] > at]
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), seed)
    return mix(h)


class Words:
    """Words of a slice of texts: byte spans, 64-bit hashes, and each text's range of words.

    `apart` says of each byte whether it separates words; the line break always does.
    """

    def __init__(self, texts: list[bytes], hashes: bool = True, apart: np.ndarray = IS_SPACE):
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_ends = np.cumsum(sizes)
        self.text_starts = self.text_ends - sizes
        space = apart[self.data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).view(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.text_starts)
        self.last = np.searchsorted(self.starts, self.text_ends)
        self.counts = self.last - self.first
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        if hashes:
            self.hash = span_hashes(self.data, self.starts, self.ends)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def bit_table(hashes: DataFrame, max_bits: int) -> np.ndarray:
    """A bit for each hash of a written table (column h): a filter of at most max_bits bits.

    Sized at 64 bits a hash up to that bound; past it the filter passes more
    rows that are no hits, never fewer that are.
    """
    from pyspark.sql import functions as F

    bits, n = 1 << 16, hashes.count()
    while bits < max_bits and bits < 64 * n:
        bits *= 2
    word = F.shiftright(F.col("h").bitwiseAND(F.lit(bits - 1)), 6).alias("word")
    mask = F.expr("shiftleft(1L, cast(h & 63 as int))").alias("mask")
    got = hashes.select(word, mask).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy()
    return out


def has_bit(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = h & (len(bitmap) * 64 - 1)
    return (bitmap[slot >> 6] >> (slot & 63)) & 1 == 1


def bit_flag(bitmap: np.ndarray, spark: SparkSession):
    """An Arrow function of a column of longs: whether the bit table has the number's bit."""
    from pyspark.sql import functions as F

    shared = spark.sparkContext.broadcast(bitmap)

    def run(column: pa.Array) -> pa.Array:
        return pa.array(has_bit(shared.value, column.to_numpy(zero_copy_only=False)))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "boolean")

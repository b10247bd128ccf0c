"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words everywhere in this package.
SPACE = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A temporary one is set only where the session has none and runs on one machine."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where


#: Rows of a few numbers each that are worth a file. On a local file system Hadoop starts several processes for each file that
#: it writes, and each of them shares its executor's memory at first.
FILE_ROWS = 20_000


def _few_files(df: DataFrame, rows: int | None) -> DataFrame:
    return df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write df to the shared folder and cut its lineage; a lost executor cannot take it along. rows: as for stored."""
    shared_dir(df.sparkSession)
    return _few_files(df, rows).checkpoint(eager=True)


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder, read back by the same session. rows: about how many it has at most, where these are small; it then takes no more files than they fill."""
    spark = df.sparkSession
    df = _few_files(df, rows)
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, a null text as the empty one; other columns and their names do not matter."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def chunks(sizes: list[int], most: int):
    """Ranges (start, end) of neighbouring rows whose sizes add up to about most; every row is in one of them."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def parts(batches, column: int = 1, most: int = 1 << 20):
    """Record batches cut so that one column of each holds about most characters or bytes, which bounds what is in memory beside them."""
    import pyarrow.compute as pc

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_pylist()
        for i, j in chunks(sizes, most):
            yield b.slice(i, j - i)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "float": pa.float32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (the finaliser of the public SplitMix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the words in UTF-8 bytes; the six white-space characters are single bytes there."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    return edge[::2], edge[1::2]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial over scrambled bytes, by prefix sums in modular arithmetic."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    coded = byte_codes(seed)[raw]
    coded *= powers(_MULTIPLIER, np.arange(len(raw), dtype=np.uint32))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(coded, out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(pow(_MULTIPLIER, -1, 1 << 64), starts) ^ mixed((ends - starts).astype(np.uint64) + np.uint64(seed + 1)))


_MULTIPLIER = 0x9E3779B97F4A7C15
_TABLES: dict = {}


def powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """Powers modulo 2^64, from tables of those of base and of base^2^10; what a worker keeps is small whatever it reads."""
    low = _TABLES.get(base)
    if low is None:
        low = _TABLES[base] = _series(base, 1 << 10)
    last = int(exponents.max()) >> 10 if len(exponents) else 0
    high = _series(pow(base, 1 << 10, 1 << 64), last + 1)
    return high[exponents >> 10] * low[exponents & 1023]


def _series(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def byte_codes(seed: int = 0) -> np.ndarray:
    key = ("codes", seed)
    if key not in _TABLES:
        _TABLES[key] = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return _TABLES[key]

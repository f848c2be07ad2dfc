"""What several operators of this package share."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marksheet.plans.lineage import delete_path, scratch_path

WORD = r"[^\x20\x09-\x0D]+"
BATCH = 1 << 21         # bytes of an Arrow batch that a Python worker gets, about
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(text, UPPER, LOWER)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves ``part`` when divided by ``parts`` (a null id never does)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; bytes.split() splits at exactly the six ASCII white-space characters."""
    return text.encode().split() if text else []


def id_field(df: DataFrame, id_col: str) -> T.StructField:
    return T.StructField(id_col, df.schema[id_col].dataType)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and back-quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, in any case."""
    prefix = "_w"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def text_key(text: Column) -> Column:
    """64 bits of a text that tell rows with one id apart; null for null."""
    return F.xxhash64(text)


def matching_rows(docs: DataFrame, wanted: DataFrame, keys: dict[str, Column], carry: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose ``keys`` (null equals null) are a row of ``wanted``, one for each.

    ``wanted`` has a unique row per key, with ``n``, the number of rows of ``docs`` that have it.  Where
    it is over one any of them stays; only those are shuffled a second time, after a partial choice.  The
    columns are those of ``docs``, whatever their names, and with ``carry`` a struct of these columns of
    ``wanted`` in front.
    """
    prefix = free_prefix(docs)
    own = [f"{prefix}_{k}" for k in keys]
    marked = docs.withColumns(dict(zip(own, keys.values())))
    found = F.lit(True)
    for name, key in zip(own, keys):
        found = found & F.col(name).eqNullSafe(F.col(f"{prefix}w_{key}"))
    extra = F.struct(*[F.col(f"{prefix}w_{c}").alias(c) for c in carry or []]).alias(f"{prefix}_carry")
    columns = ([extra] if carry else []) + [quoted(c) for c in docs.columns]

    def joined(part: DataFrame) -> DataFrame:
        right = part.select(*[F.col(c).alias(f"{prefix}w_{c}") for c in [*keys, *(carry or [])]])
        return marked.join(right, found, "inner" if carry else "left_semi")

    single = joined(wanted.filter("n = 1")).select(*columns)
    repeated = wanted.filter("n > 1")
    if repeated.isEmpty():
        return single
    # One row a key, by a combinable choice, so that a hot key meets nowhere.
    one = joined(repeated).groupBy(*own).agg(F.first(F.struct(*columns)).alias(f"{prefix}_row"))
    return single.union(one.select(F.col(f"{prefix}_row.*")))


def small_batches(spark: SparkSession) -> None:
    """From now on the session hands texts to Python workers in Arrow batches of about ``BATCH`` bytes.

    Spark's own bounds, 10,000 rows and 64 MB, are for each buffer; a task that encodes and decodes has
    several in both its workers and in the JVM, whose memory stays theirs.  A longer text is a batch alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def map_texts(df: DataFrame, columns: list[str], schema: T.StructType,
              batch: Callable[[dict[str, pa.Array]], Iterator[dict]]) -> DataFrame:
    """``df[columns]`` through ``batch``, an Arrow batch at a time; ``batch`` yields columns of ``schema``."""
    to = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])

    def run(batches):
        for part in batches:
            for out in batch(dict(zip(columns, part.columns))):
                yield pa.RecordBatch.from_arrays([_column(out[f.name], f.type) for f in to], schema=to)

    return df.select(*columns).mapInArrow(run, schema)


def _column(values, kind) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


class Scratch:
    """Tables written below ``spark.checkpoint.dir``; ``drop`` deletes those that are no longer needed."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, str] = {}
        self._alive: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written table: lineage is cut and a lost executor costs a re-read."""
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(written)] = path
        self._alive.append(written)   # so that no later table has the same id()
        return written

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            delete_path(self.spark, self.paths.pop(id(table)))

    def only(self, *tables: DataFrame) -> None:
        """Delete all but these, which the result still reads."""
        for key in set(self.paths) - {id(t) for t in tables}:
            delete_path(self.spark, self.paths.pop(key))

"""What the training-data operators share: input shaping, lineage cuts, memoised word tables."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BITMAP = 1 << 22  # bits
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_written: list[tuple[SparkSession, str]] = []
_own: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where that is unset, a master of one machine (local[...]) gets a folder of its own; on a cluster this is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        path = _own.setdefault(id(spark), "file://" + tempfile.mkdtemp(prefix="inkspan-"))
    return path.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer rows an Arrow batch for what is run inside: whole texts travel in them, and both ends of the pipe hold them."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, min(int(before), 2000) if int(before) > 0 else 2000)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that a lost executor costs one stage only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkspan-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    with small_batches(spark):
        df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(schema).parquet(path)


def drop_cut(*frames: DataFrame) -> None:
    """Delete the files behind frames made by :func:`cut` once nothing reads them any more."""
    for df in frames:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/inkspan-" in path:
                _remove(df.sparkSession, path)
                # what is gone needs no clean-up at exit
                _written[:] = [e for e in _written if e[1].split(":", 1)[-1].lstrip("/") != path.split(":", 1)[-1].lstrip("/")]


def remove_written(path: str) -> None:
    """Delete what :func:`cut` wrote to ``path``, if it is still known."""
    for entry in [e for e in _written if e[1] == path]:
        _remove(*entry)
        _written.remove(entry)


def settled(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The operator with its result written, and with all that it wrote on the way deleted."""

    @wraps(operator)
    def run(*args, **kwargs) -> DataFrame:  # noqa: ANN002, ANN003
        first = len(_written)
        out = cut(operator(*args, **kwargs), operator.__name__)
        for spark, path in _written[first:-1]:
            _remove(spark, path)
        del _written[first:-1]
        return out

    return run


def numbered(df: DataFrame, label: str, name: str = "uid") -> DataFrame:
    """``df``, written, with a number of its own for every row: unlike a hash, never shared by two rows."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()), label)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fields(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator needs, under internal names that extra input columns cannot clash with."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def marked(df: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """``df`` with ``marked``: true for every row whose id is in ``wanted`` (same column name), and for few others.

    The test is a bitmap over the ids' hashes. It has at most BITMAP / 64 rows whatever is wanted, so it is broadcast;
    where it fills up, more rows are marked, never fewer. A null id is not marked.
    """
    bit = F.pmod(F.xxhash64(F.col(id_col).cast(wanted.schema[id_col].dataType)), F.lit(BITMAP))
    bit = F.when(F.col(id_col).isNotNull(), bit)
    words = wanted.select(bit.alias("_bit")).groupBy(F.floor(F.col("_bit") / 64).alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit % 64 AS int)))").alias("_bits"))
    found = df.withColumn("_bit", bit).withColumn("_word", F.floor(F.col("_bit") / 64)).join(F.broadcast(words), "_word", "left")
    hit = F.getbit("_bits", F.pmod("_bit", F.lit(64)).cast("int")) == 1
    return found.withColumn("marked", F.coalesce(hit, F.lit(False))).drop("_bit", "_word", "_bits")


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A mapInArrow function that, when its task ends, gives the memory it freed back to the machine: Python workers
    outlive their tasks and stages, and what they keep counts against the executor."""

    @wraps(run)
    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return tidied


class Memo(dict):
    """word -> value, computed once per Python worker; emptied when it reaches ``limit`` entries."""

    def __init__(self, compute: Callable, limit: int = 300_000) -> None:
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, key):  # noqa: ANN001, ANN204
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.compute(key)
        return value


def rows_of(batches: Iterable, *names: str) -> Iterator[tuple[list, ...]]:
    """Arrow record batches as tuples of Python lists, one per named column."""
    for batch in batches:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


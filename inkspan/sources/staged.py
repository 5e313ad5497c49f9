"""Tables that are replaced by key: hash buckets, written beside the old ones and switched over by one small file.

``path/parts/<run>/bucket=<n>`` holds the rows that came, ``path/parts/<run>/stayed/bucket=<n>`` those that were left, and
``path/versions/<version>.json`` says which of these hold each bucket. A reader takes the newest version file and sees all of
a write or nothing of it; a writer that dies leaves only unread parts.
"""

from __future__ import annotations

import atexit
import json
import tempfile
import uuid
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_own: dict[int, str] = {}
_made: list[tuple[SparkSession, str]] = []


def working_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a session on one machine gets one of its own where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and all executors of {master} share")
        path = _own.setdefault(id(spark), "file://" + tempfile.mkdtemp(prefix="inkspan-work-"))
    return path.rstrip("/")


def new_place(spark: SparkSession, label: str) -> str:
    """A path below the working folder that nobody uses; it is deleted when the program ends."""
    path = f"{working_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as files in the working folder, so that what reads it twice sees the same rows and partitions."""
    path = new_place(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            fs, target = _fs(spark, path)
            fs.delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            return


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/versions")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))


def _state(spark: SparkSession, path: str, version: int) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(f"{path}/versions/{version:08d}.json").collect()))


def _commit(spark: SparkSession, path: str, version: int, state: dict) -> None:
    """The version file appears whole or not at all; a second writer of the same version fails."""
    fs, target = _fs(spark, f"{path}/versions/{version:08d}.json")
    _, staged = _fs(spark, f"{path}/versions/.{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps(state).encode()))
    out.close()
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        raise RuntimeError(f"version {version} of {path} was written by someone else")


def _runs(state: dict) -> dict[str, list[str]]:
    """The runs of each bucket; older tables name one run."""
    return {b: [r] if isinstance(r, str) else r for b, r in state["runs"].items()}


def _read(spark: SparkSession, path: str, state: dict, buckets: list[int] | None = None, run: str | None = None) -> DataFrame:
    from pyspark.sql.types import StructType

    schema = StructType.fromJson(state["schema"])
    wanted = [(b, r) for b, runs in _runs(state).items() for r in runs if (buckets is None or int(b) in buckets) and run in (None, r)]
    folders = [f"{path}/parts/{r}/bucket={b}" for b, r in wanted]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of an older one whose parts were not cleaned up yet."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no version of {path}")
    return _read(spark, path, _state(spark, path, known[-1] if version is None else version))


def read_written(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The rows that came with a version, without those that stayed."""
    state = _state(spark, path, version)
    return _read(spark, path, state, run=state["run"])


def replace_by_key(df: DataFrame, path: str, key: str, buckets: int = BUCKETS, hot_keys: bool = True) -> int:
    """Delete-then-insert: all stored rows of the keys in ``df`` go, the rows of ``df`` come; gives the new version.

    Only buckets that hold one of the keys are written again, each by its own tasks, so the number of files is bounded by
    buckets and tasks and not by keys. ``buckets`` counts at the first write only. A key that leaves no rows behind
    is deleted by a row whose other columns are all null (``df`` otherwise holds none such). Null keys are one key.
    ``df`` is computed and shuffled once; what it replaces is then found by the keys in the files it went to. A bucket's
    rows are dealt to a few tasks, so that a hot key is not written by one; where every key has few rows, ``hot_keys=False``
    leaves them together, and rows that come from a window or join by the key are not shuffled again.
    """
    from pyspark.sql.types import IntegerType, StructField, StructType

    spark = df.sparkSession
    known = versions(spark, path)
    state = _state(spark, path, known[-1]) if known else {"buckets": buckets, "hash": "hash", "schema": json.loads(df.schema.json()), "runs": {}}
    columns = [f["name"] for f in state["schema"]["fields"]]
    # the hash that shuffles use too, so that a task of a shuffle by the key meets few buckets; older tables have the other one
    at = F.pmod((F.hash if state.get("hash") == "hash" else F.xxhash64)(F.col(f"`{key}`")), F.lit(state["buckets"])).cast("int")

    def put(rows: DataFrame, bucket: Column, run: str) -> set[int]:
        """Rows as files of a run; gives the buckets that it has."""
        rows = rows.select(*[F.col(f"`{c}`") for c in columns])
        if hot_keys:
            spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(4))
            rows = rows.withColumns({"bucket": bucket, "_spread": spread}).repartition("bucket", "_spread").drop("_spread")
        else:
            rows = rows.repartition(F.col(f"`{key}`")).withColumn("bucket", bucket)
        rows.write.partitionBy("bucket").parquet(f"{path}/parts/{run}")
        fs, folder = _fs(spark, f"{path}/parts/{run}")
        return {int(s.getPath().getName().removeprefix("bucket=")) for s in fs.listStatus(folder) if s.isDirectory()}

    # rows that only delete go to folders below 0, which no reader takes
    rest = [F.col(f"`{c}`").isNotNull() for c in columns if c != key]
    run = uuid.uuid4().hex
    filled = put(df, F.when(reduce(or_, rest), at).otherwise(-1 - at) if rest else at, run)
    touched = sorted({b if b >= 0 else -1 - b for b in filled})
    before = _runs(state)
    runs = {b: r for b, r in before.items() if int(b) not in touched} | {str(b): [run] for b in filled if b >= 0}
    if any(int(b) in touched for b in before):
        held = StructType([StructType.fromJson(state["schema"])[key], StructField("bucket", IntegerType())])
        keys = spark.read.schema(held).parquet(f"{path}/parts/{run}").select(F.col(f"`{key}`").alias("_key"))
        old = _read(spark, path, state, touched)
        if not keys.filter("_key IS NULL").isEmpty():
            old = old.filter(F.col(f"`{key}`").isNotNull())
        left = put(old.join(keys.distinct().hint("shuffle_hash"), F.col(f"`{key}`") == F.col("_key"), "left_anti"), at, f"{run}/stayed")
        runs |= {str(b): [*runs.get(str(b), []), f"{run}/stayed"] for b in left}
    version = (known[-1] if known else 0) + 1
    _commit(spark, path, version, {**state, "runs": runs, "run": run})
    return version


def clean_up(spark: SparkSession, path: str) -> int:
    """Delete versions but the newest one and the parts that it does not name; gives how many runs went."""
    known = versions(spark, path)
    held = {r.split("/")[0] for runs in _runs(_state(spark, path, known[-1])).values() for r in runs} if known else set()
    for v in known[:-1]:
        fs, target = _fs(spark, f"{path}/versions/{v:08d}.json")
        fs.delete(target, False)
    fs, folder = _fs(spark, f"{path}/parts")
    gone = [s.getPath() for s in fs.listStatus(folder) if s.getPath().getName() not in held] if fs.exists(folder) else []
    for p in gone:
        fs.delete(p, True)
    return len(gone)

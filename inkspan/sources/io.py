"""Sources and sinks: uploads, dictionaries, templates, parsed lines, replies; seed merges, DDL. Overwriting by key is in ``staged``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MAX_BYTES, MAX_PAGES, LEAST_CHARS = 20 * 1024 * 1024, 10, 100


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(filename, content, size, file_hash) of binary files."""
    d = spark.read.format("binaryFile").load(path)
    return d.select(F.regexp_extract("path", "([^/]+)$", 1).alias("filename"), "content", F.col("length").alias("size"), F.sha2("content", 256).alias("file_hash"))


def upload_error(filename: Column, content: Column, size: Column, pages: Column | None = None, encrypted: Column | None = None) -> Column:
    """First failed check, cheap ones first: kind, size, encryption, pages; null if all pass."""
    error = F.when(~F.lower(filename).endswith(".pdf") | (F.substring(content, 1, 5) != F.lit(b"%PDF-")), "not a PDF").when(size > MAX_BYTES, "too large")
    if encrypted is not None:
        error = error.when(encrypted, "encrypted")
    return error.when(pages > MAX_PAGES, "too many pages") if pages is not None else error


def parse_error(lines: DataFrame) -> DataFrame:
    """Documents that look scanned: fewer than 100 characters over all their lines."""
    n = lines.groupBy("resume_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
    return n.withColumn("parse_error", F.when(F.col("chars") < LEAST_CHARS, "scanned"))


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(domain, file, title, raw_text) of *.txt files in one folder per domain: the first line is the title."""
    d = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("_f", F.input_file_name())
    return d.select(F.regexp_extract("_f", "([^/]+)/[^/]+$", 1).alias("domain"), F.regexp_extract("_f", "([^/]+)$", 1).alias("file"), F.trim(F.substring_index("value", "\n", 1)).alias("title"), F.trim(F.regexp_replace("value", "^[^\\n]*\\n?", "")).alias("raw_text"))


def read_json_templates(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def append_audit(df: DataFrame, path: str) -> None:
    df.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def merge_seed(stored: DataFrame, new: DataFrame, key: str, id_col: str = "id", scope: Column | None = None) -> DataFrame:
    """Stored rows after a seed list is put in, with ``change``: updated, inserted, deleted or kept.

    One full outer join by key tells the three cases apart: a listed row that is stored keeps its id and takes all other
    columns of the list; one that is not stored gets the next free id, in order of key; a stored row that is no longer
    listed is marked deleted, if it is in ``scope`` (default: all) and not deleted yet. Rows out of scope stay as they
    are, also where their key is listed; so do rows with a null key. Keys in scope and in the list are unique. The columns of
    ``stored`` are id_col, key, is_deleted and any that ``new`` has or not; what ``new`` lacks stays, null for inserted rows.
    """
    from inkspan.operators.ranking import with_position

    columns = stored.columns
    inside = (F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))) & F.col(f"`{key}`").isNotNull()
    s = stored.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("s"), F.when(inside, F.col(f"`{key}`")).alias("_k"))
    n = new.filter(F.col(f"`{key}`").isNotNull()).select(F.struct(*[F.col(f"`{c}`") for c in new.columns]).alias("n"), F.col(f"`{key}`").alias("_n"))
    d = s.join(n, F.col("_k") == F.col("_n"), "full_outer")
    here, listed = F.col("s").isNotNull(), F.col("n").isNotNull()
    gone = here & ~listed & F.col("_k").isNotNull()
    change = F.when(here & listed, "updated").when(listed, "inserted").when(gone & ~F.coalesce("s.is_deleted", F.lit(False)), "deleted").otherwise("kept")
    value = {c: F.when(listed, F.col(f"n.`{c}`")).otherwise(F.col(f"s.`{c}`")) if c in new.columns else F.col(f"s.`{c}`") for c in columns}
    value[id_col] = F.col(f"s.`{id_col}`")
    value["is_deleted"] = F.when(listed, False).when(gone, True).otherwise(F.col("s.is_deleted"))
    d = d.select(*[value[c].alias(c) for c in columns], change.alias("change"))
    free = (stored.agg(F.max(id_col)).first()[0] or 0) + 1
    added = with_position(d.filter("change = 'inserted'"), key, name="_id", first=free).withColumn(id_col, F.col("_id").cast(stored.schema[id_col].dataType)).drop("_id")
    return d.filter("change != 'inserted'").unionByName(added)


def write_diagnoses(findings: DataFrame, rejected: DataFrame | None, diagnoses: DataFrame, calls: DataFrame, path: str) -> None:
    """Write back finished diagnoses: their findings (shown and rejected ones) and, with counters, tokens and status, the
    diagnoses themselves, each replacing what is stored for the same diagnosis.

    findings and rejected: diagnosis_id, source, attempt_no, verify_result and more of the same columns (or findings alone,
    with a column ``shown``); diagnoses: diagnosis_id, resume_id, units_total, units_skipped, overall_score; calls: model
    calls. Findings are written before the diagnoses, which name them, and counted as they were written; read both with
    ``staged.read_current`` from path/findings and path/diagnoses.
    """
    from inkspan.operators import rules, upkeep
    from inkspan.sources import staged

    spark = diagnoses.sparkSession
    both = findings if rejected is None else findings.withColumn("shown", F.lit(True)).unionByName(rejected.withColumn("shown", F.lit(False)))
    version = staged.replace_by_key(both, f"{path}/findings", "diagnosis_id", hot_keys=False)
    counted = rules.diagnosis_counters(staged.read_written(spark, f"{path}/findings", version), diagnoses)
    refs = counted.withColumns({"ref_type": F.lit("diagnosis"), "ref_id": F.col("diagnosis_id")})
    rows = upkeep.tokens_of(refs, calls).drop("ref_type", "ref_id").withColumns({c: F.col(c).cast("long") for c in ("token_input", "token_output")})
    staged.replace_by_key(rows, f"{path}/diagnoses", "diagnosis_id", hot_keys=False)


def ddl(name: str, schema: StructType) -> str:
    columns = ",\n".join(f"  {f.name} {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in schema.fields)
    return f"CREATE TABLE {name} (\n{columns}\n)"


def write_runs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)

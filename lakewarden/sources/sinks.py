"""Writers: JSON lines, CSV in a fixed order, idempotent and versioned outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str], overwrite: bool = False) -> None:
    """CSV with a header and exactly ``columns`` in that order, as many part files as the table has partitions."""
    df.select(*columns).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True)


def fingerprint(df: DataFrame, ignore: tuple[str, ...] = ("generated_at_utc",)) -> tuple[int, int]:
    """Rows and an order-independent sum of row hashes, without the columns ``ignore``; one pass, two numbers."""
    columns = sorted(c for c in df.columns if c not in ignore)
    hashed = F.xxhash64(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    row = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(hashed), F.lit(0)).alias("h")).first()
    return row.n, int(row.h)


def write_if_changed(df: DataFrame, path: str, ignore: tuple[str, ...] = ("generated_at_utc",)) -> bool:
    """Writes Parquet unless what is there is the same but for ``ignore``; whether it wrote."""
    spark: SparkSession = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        old = spark.read.parquet(path)
        if sorted(old.columns) == sorted(df.columns) and fingerprint(old, ignore) == fingerprint(df, ignore):
            return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_versioned(df: DataFrame, path: str, version: str, canonical: bool = True) -> None:
    """Writes a version of its own and, if asked, the same as canonical."""
    df.write.mode("errorifexists").parquet(f"{path}/versions/{version}")
    if canonical:
        df.write.mode("overwrite").parquet(f"{path}/canonical")


def rows_as_markdown(rows: list, columns: list[str]) -> str:
    """A small report table from collected rows."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |" for r in rows)]) + "\n"

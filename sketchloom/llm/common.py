"""What the operators of this subpackage share: tables, shared folders, words."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte alone.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """The runs of other than U+0020 and U+0009 to U+000D, as UTF-8; null has none.

    bytes.split() parts at just these six bytes.
    """
    return text.encode("utf-8", "surrogatepass").split() if text else []


def id_remainder(value: int | None, modulus: int) -> int:
    """crc32 of an id's decimal text, modulo modulus; a null id counts as empty text."""
    return zlib.crc32(b"" if value is None else str(value).encode()) % modulus


def id_remainder_column(column: str | Column, modulus: int) -> Column:
    """The same as a column."""
    column = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df under names that clash with none of an operator's, and those names by its own; toDF(*df.columns) gives these back."""
    names = {c: f"c{k}" for k, c in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def free_name(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has."""
    while name in df.columns:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir, which all executors share.

    Only where that is unset, and the master is this machine, a local folder stands in.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="sketchloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/sketchloom-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None, rows_a_file: int = 0) -> DataFrame:
    """df as a table in the shared folder, read back: it is computed once and survives lost executors. rows_a_file 0: no bound."""
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    df.write.options(compression="zstd", maxRecordsPerFile=rows_a_file).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def removed(spark: SparkSession, *folders: str) -> None:
    """Deletes tables that nothing reads any more, wherever the shared folder is."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_spread(rows: DataFrame, few: DataFrame, key: str, how: str = "inner", n: str = "n", share: int = 1000) -> DataFrame:
    """rows joined to `few` by key, which has one row a key (a written table) and in n how many of `rows` have it; n is dropped.

    A key with more than one in `share` of the rows counted is dealt to as many more tasks.
    There are fewer than `share` such keys, so that they may be sent to all tasks.
    """
    total = few.agg(F.sum(n)).first()[0] or 1
    few = few.withColumn("__salts", F.ceil(F.col(n) * F.lit(share) / F.lit(total))).drop(n)
    hot = few.where("__salts > 1").select(key, F.col("__salts").alias("__most"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("__most", F.lit(1)))).drop("__most")
    few = few.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__salts") - 1))).drop("__salts")
    return dealt.join(few, [key, "__salt"], how).drop("__salt")

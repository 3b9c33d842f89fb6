"""CSV text source (S3) and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polarity.schemas import require_columns
from polarity.sources.split_csv import read_csv_split

# Both sides of a round trip: texts keep their white space, null and the empty
# text stay apart.
CSV = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false",
       "ignoreTrailingWhiteSpace": "false", "nullValue": "\\N"}
FILES_PER_VALUE = 16


def read_text_csv(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  text_col: str = "text", multi_line: bool = True, split: bool = False) -> DataFrame:
    """S3: header CSV with quoted multi-line text; ``ValueError`` without
    ``text_col``. Without a schema every column is read as a string.

    White space is kept. ``\\N`` and an unquoted empty field are null, ``""``
    is the empty text, as :func:`write_csv` writes them. ``multi_line=False`` reads files
    whose texts hold no line break and splits them over many tasks; the
    default reads a file in one task. ``split=True`` reads texts with line breaks
    in many tasks, at the price of a second pass (see ``split_csv``).
    """
    reader = spark.read.options(**CSV).option("multiLine", multi_line)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.csv(path)
    if split:
        df = read_csv_split(spark, path, df.schema, {k: v for k, v in CSV.items() if k != "header"})
    require_columns(df, [text_col], f"CSV {path}")
    return df


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Header CSV, distributed write; ``partition_by`` gives one folder
    per value (e.g. per company)."""
    w = _clustered(df, partition_by).write.mode(mode).options(**CSV)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def _clustered(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """Rows of a value in a few tasks, so that a folder gets at most
    ``FILES_PER_VALUE`` files; a hot value is dealt over all of them."""
    if not partition_by:
        return df
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(FILES_PER_VALUE))
    return df.repartition(*partition_by, salt)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    w = _clustered(df, partition_by).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)

"""Scans: delimited tables, the curated table, scorer replies and reports."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from triptych.functions.text import exact, is_number_text, na_to_null
from triptych.operators.headers import require_columns, trim_headers

FILE_COLUMN, BLOCK_COLUMN, ROW_COLUMN = "_file", "_block", "_row"
INPUT_ORDER = (FILE_COLUMN, BLOCK_COLUMN, ROW_COLUMN)

# The column names of the base and the curated table.
BASE_COLUMNS = ("Idiom", "Meaning(s)", "Matching German Idiom")
ID_COLUMN = "Idiom ID"
CURATED_COLUMNS = {"english_idiom": "English Idiom", "urdu_roman": "Roman Urdu", "urdu_native": "Urdu Native"}

_OVERFLOW, _BROKEN = "_overflow", "_broken"


def _unique_names(header: Sequence[str | None]) -> list[str]:
    """Names for blank and repeated headers: `Unnamed: 2`, `x.1`."""
    names: list[str] = []
    for position, raw in enumerate(header):
        name = raw if raw else f"Unnamed: {position}"
        if name in names:
            name = next(f"{name}.{i}" for i in count(1) if f"{name}.{i}" not in names)
        names.append(name)
    return names


def read_table(spark: SparkSession, path: str, multiline: bool = True,
               input_order: bool = False) -> DataFrame:
    """Delimited files with a header, every column text, missing marks as NULL.

    All files must have the same header in the same order; a file with another
    one stops the job. (Blank and repeated headers get names of their own; then
    the headers of the files cannot be compared.) A row with too few fields is
    filled with NULL; one with too many stops the job. With `multiline` a field
    may hold line breaks, and each file is read by one task. Without it large
    files split; as a line break inside quotes would break a row in two, any
    row with too few fields stops the job then. With `input_order` the columns
    INPUT_ORDER are added; they sort as the rows stand in the files.
    """
    options = {"multiLine": multiline, "quote": '"', "escape": '"', "encoding": "UTF-8",
               "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    first = spark.read.options(**options, header=False).csv(path).first()
    if first is None:
        raise ValueError(f"no header in {path}")
    names = _unique_names(list(first))
    text = [T.StructField(n, T.StringType()) for n in names]
    rows = (spark.read.options(**options, header=True, mode="PERMISSIVE", enforceSchema=names != list(first),
                               columnNameOfCorruptRecord=_BROKEN)
            .schema(T.StructType([*text, T.StructField(_BROKEN, T.StringType())])).csv(path))
    # A row of another width comes with its text; whether it is too wide is seen by parsing it once more.
    wider = T.StructType([*text, T.StructField(_OVERFLOW, T.StringType())]).toDDL()
    parser = {k: str(options[k]).lower() for k in ("multiLine", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace")}
    overflow = F.from_csv(F.col(_BROKEN), wider, {**parser, "quote": '"', "escape": '"'})[_OVERFLOW]
    stop = overflow.isNotNull() if multiline else F.lit(True)
    problem = f"a row of {path} has more fields than its header" + (
        "" if multiline else ", or fewer, as rows with a line break in a field have")
    begins = F.concat(F.lit(f"{problem}: it begins with "), F.coalesce(exact(names[0]), F.lit("nothing")))
    width_checked = F.when(F.col(_BROKEN).isNull(), True).when(
        stop, F.raise_error(begins).cast("boolean")).otherwise(True)
    kept = [na_to_null(exact(n)).alias(n) for n in names]
    if input_order:
        kept += [F.col("_metadata.file_path").alias(FILE_COLUMN),
                 F.struct("_metadata.file_block_start", "_metadata.file_block_length").alias(BLOCK_COLUMN),
                 F.monotonically_increasing_id().alias(ROW_COLUMN)]
    return trim_headers(rows.filter(width_checked).select(*kept))


def read_base(spark: SparkSession, path: str, file_format: str = "csv",
              multiline: bool = True) -> DataFrame:
    """The base idiom table, checked for its three required columns."""
    if file_format == "csv":
        table = read_table(spark, path, multiline, input_order=True)
    elif file_format == "parquet":
        rows = spark.read.parquet(path)
        table = trim_headers(rows.select(
            *(exact(c) for c in rows.columns), F.col("_metadata.file_path").alias(FILE_COLUMN),
            F.lit(0).alias(BLOCK_COLUMN), F.col("_metadata.row_index").alias(ROW_COLUMN)))
    else:
        raise ValueError(f"unknown format {file_format!r}")
    require_columns(table, BASE_COLUMNS)
    return table


def whole_number(column: Column) -> Column:
    """Ids as long: `7`, `7.0` and numbers without a fraction; anything else stops the job."""
    text = F.trim(column.cast("string"))
    exponent = text.rlike(r"^[+-]?\d+(\.\d+)?E\d+$")
    number = F.when(exponent, text.try_cast("double").cast("decimal(38,0)").cast("string")).otherwise(
        F.regexp_extract(text, r"^([+-]?\d+)(\.0*)?$", 1))
    return F.when(text.isNull(), F.lit(None)).when(number != "", number.try_cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("not a whole number: "), text)).cast("long"))


def read_curated(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """The reviewed idiom table: idiom_id, english_idiom, urdu_roman, urdu_native.

    Its columns are found by name, whatever their order.
    """
    table = read_table(spark, path, multiline)
    require_columns(table, [ID_COLUMN, *CURATED_COLUMNS.values()])
    return table.select(whole_number(exact(ID_COLUMN)).cast("int").alias("idiom_id"),
                        *(exact(c).alias(name) for name, c in CURATED_COLUMNS.items()))


def read_replies(spark: SparkSession, path: str, keys: Sequence[str] = ("seg_id",),
                 on_bad: str = "fail") -> DataFrame:
    """Scorer replies, one JSON object per line: the keys, task, prediction.

    `on_bad="fail"` stops at the first line without a numeric prediction.
    `on_bad="drop"` leaves such lines out, so that the count check of
    `attach_scores` then leaves out the whole task.
    """
    if on_bad not in ("fail", "drop"):
        raise ValueError(f"on_bad is 'fail' or 'drop', not {on_bad!r}")
    schema = ", ".join([*(f"`{k}` long" for k in keys), "task string", "prediction string"])
    mode = "FAILFAST" if on_bad == "fail" else "PERMISSIVE"
    rows = spark.read.schema(schema).option("mode", mode).json(path)
    numeric = F.coalesce(is_number_text(F.col("prediction")), F.lit(False))
    if on_bad == "drop":
        value: Column = F.col("prediction").try_cast("double")
        rows = rows.filter(numeric)
    else:
        value = F.when(numeric, F.col("prediction").try_cast("double")).otherwise(
            F.raise_error(F.concat(F.lit("not a prediction: "),
                                   F.coalesce("prediction", F.lit("NULL")))).cast("double"))
    return rows.select(*keys, "task", value.alias("prediction"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Report files of any kind; bare and quoted NaN are both numbers."""
    schema = ("language string, model string, method string, note string, "
              "averages map<string,double>, win_rates map<string,double>, win_rate_A_vs_B double")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)

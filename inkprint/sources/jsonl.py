"""JSON lines in and out. Schemas are always stated, never inferred from the data."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkprint.functions.text import file_stem
from inkprint.operators.combine import concat_rows

log = logging.getLogger(__name__)

DOCUMENT = "id long, text string, label int, model string"
PERPLEXITY = "id long, perplexity double"
PREDICTION = "id long, label int"
_CORRUPT = "_corrupt_record"


def _parsed(schema: str | T.StructType) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


def read_jsonl(spark: SparkSession, paths: str | Sequence[str], schema) -> DataFrame:
    """Read JSON lines; a malformed line is an error."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.schema(_parsed(schema)).option("mode", "FAILFAST").json(paths)


def existing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Paths that can be read; the others are logged."""
    found = []
    for path in paths:
        try:
            spark.read.text(path)
            found.append(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            log.warning("no such file: %s", path)
    return found


def parsed_lines(
    spark: SparkSession, paths: Sequence[str], schema, path: str | None = None
) -> DataFrame:
    """(line, row, malformed): every non-blank line with what it parses to.

    ``path`` names a column for the file that a line was read from.
    """
    # Lines are parsed as a column, so good and bad ones come from the same expression.
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
    fields = [*_parsed(schema).fields, T.StructField(_CORRUPT, T.StringType())]
    lines = spark.read.text(list(paths)).filter(F.trim("value") != "")
    file = F.regexp_replace(F.col("_metadata.file_path"), "^file:(//)?", "")
    rows = lines.select(
        *([file.alias(path)] if path else []),
        F.col("value").alias("line"),
        F.from_json("value", T.StructType(fields), options).alias("row"),
    )
    malformed = F.col(f"row.{_CORRUPT}").isNotNull() | F.col("row").isNull()
    return rows.withColumn("malformed", malformed)


def read_with_quarantine(
    spark: SparkSession, paths: Sequence[str], schema, key: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and (reason, line) of the rows left out.

    A missing file is skipped. A malformed line, and a line without id, costs that
    line only.
    """
    schema = _parsed(schema)
    found = existing_paths(spark, paths)
    if not found:
        return (
            spark.createDataFrame([], schema),
            spark.createDataFrame([], "reason string, line string"),
        )
    rows = parsed_lines(spark, found, schema)
    malformed, no_id = F.col("malformed"), F.col(f"row.{key}").isNull()
    good = rows.filter(~malformed & ~no_id).select(*[f"row.{f.name}" for f in schema.fields])
    bad = rows.filter(malformed | no_id).select(
        F.when(malformed, "malformed").otherwise("no id").alias("reason"), "line"
    )
    return good, bad


def read_files(spark: SparkSession, schemas: dict[str, object], source: str | None = None) -> DataFrame:
    """Concatenate files of different columns; a column a file lacks is null.

    ``source`` names a column for the stem of the file each row came from.
    """
    frames = []
    for path, schema in schemas.items():
        frame = read_jsonl(spark, path, schema)
        if source:
            frame = frame.withColumn(source, file_stem(F.lit(path)))
        frames.append(frame)
    return concat_rows(frames)


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = True) -> None:
    """Write JSON lines, one file per partition."""
    df.write.mode("overwrite").option("ignoreNullFields", str(not keep_nulls).lower()).json(path)


def write_parts(df: DataFrame, path: str, part: str = "part") -> None:
    """Write one folder of JSON lines per part, each part by one task."""
    df.repartition(part).write.mode("overwrite").partitionBy(part).json(path)


def read_parts(spark: SparkSession, path: str, schema, part: str = "part") -> DataFrame:
    """Read the folders of :func:`write_parts` back, with the part of each row."""
    whole = T.StructType([*_parsed(schema).fields, T.StructField(part, T.LongType())])
    return spark.read.schema(whole).json(path)


def layer_schema(count: int, key: str = "id") -> str:
    """Schema of a file with one column per layer, ``0`` being the last layer."""
    return ", ".join([f"{key} long", *[f"`{i}` array<double>" for i in range(count)]])


def layers_from_columns(df: DataFrame, count: int, key: str = "id") -> DataFrame:
    """(key, layers) from columns ``0``, ``1``, ...; an error if there are too few."""
    names = [str(i) for i in range(count)]
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"{count} layers requested, columns {missing} are missing")
    return df.select(key, F.array(*[F.col(f"`{c}`") for c in names]).alias("layers"))


def layers_to_columns(df: DataFrame, count: int, key: str = "id") -> DataFrame:
    """One column per layer, for writing."""
    return df.select(key, *[F.get("layers", F.lit(i)).alias(str(i)) for i in range(count)])


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only these columns; an error if one is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)

"""CSV report sink (S20): ';' separator, decimal comma, N/A for missing, header row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def format_report(df: DataFrame) -> DataFrame:
    """Doubles become text with a decimal comma; arrays become comma-free text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.replace(c.cast("string"), F.lit("."), F.lit(","))
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda v: F.replace(v.cast("string"), F.lit("."), F.lit(","))), " ")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def write_report_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    out = format_report(df)
    if single_file:  # reports are small result tables (leaderboards, top-50 lists)
        out = out.coalesce(1)
    out.write.mode("overwrite").option("sep", ";").option("header", True).option("nullValue", "N/A") \
        .option("emptyValue", "").csv(path)

"""Input-table operators.

Everything is an aggregate, filter or join over the whole table; nothing row-sized goes
through the driver.  Scalars (counts, flags) come back as one-row aggregates.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loupe.functions.clean import is_unlabelled
from loupe.functions.split import shuffle_key
from loupe.spec import TableSpec

CATEGORY_LIMIT = 30  # fixed value: at most 30 classes / category values

TEXT_TYPES = (T.StringType, T.VarcharType, T.CharType)
INT_TYPES = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's table shape: documents with a class filled for some rows only."""
    docs = load(spark, sf_dir, "documents")
    labels = load(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left")


def read_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Project exactly data + id + class columns, in that order."""
    missing = [c for c in spec.columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in table: {missing}")
    return df.select(*spec.columns)


def mode_filter(df: DataFrame, label: str, train: bool, predict: bool) -> DataFrame:
    """Train only -> labelled rows; predict only -> unlabelled rows; else all rows."""
    if train and not predict:
        return df.filter(~is_unlabelled(label))
    if predict and not train:
        return df.filter(is_unlabelled(label))
    return df


def sample_n(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """S3: n rows in a seeded random order (top-n by md5 key; a TakeOrderedAndProject)."""
    return df.orderBy(shuffle_key(seed, key), F.col(key)).limit(int(n))


def order_by_class(df: DataFrame, label: str, descending: bool = True) -> DataFrame:
    """Order by class, unlabelled last."""
    c = F.col(label)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last())


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    """Rows per class value, NULL shown as 'NULL', ordered by class descending.

    A grouped count with map-side partial aggregation: each task ships at most one row per
    class value, so a class holding a third of the rows costs nothing extra.
    """
    key = F.coalesce(F.col(label).cast("string"), F.lit("NULL")).alias("class_value")
    return (df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
            .orderBy(F.col("class_value").desc()))


def row_count(df: DataFrame) -> DataFrame:
    """S6 (as a one-row frame)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def effective_row_limit(df: DataFrame, label: str, limit: int | None, predict: bool) -> DataFrame:
    """The data limit; when not predicting, at most the number of labelled rows."""
    agg = df.agg(F.count(F.lit(1)).alias("n_rows"),
                 F.count_if(~is_unlabelled(label)).alias("n_labelled"))
    lim = F.lit(limit).cast("bigint") if limit is not None else F.col("n_rows")
    eff = lim if predict else F.least(lim, F.col("n_labelled"))
    return agg.select(F.col("n_rows"), F.col("n_labelled"), eff.alias("row_limit"))


def can_predict(df: DataFrame, label: str) -> DataFrame:
    """The table has rows to predict (class NULL or blank)."""
    return df.agg(F.coalesce(F.max(is_unlabelled(label)), F.lit(False)).alias("can_predict"))


def class_column_valid(df: DataFrame, label: str, limit: int = CATEGORY_LIMIT) -> DataFrame:
    """Number of class values (NULL counts as one) is at most ``limit``."""
    agg = df.agg(F.count_distinct(F.col(label)).alias("n_values"),
                 F.max(F.col(label).isNull()).cast("int").alias("has_null"))
    n = (F.col("n_values") + F.coalesce(F.col("has_null"), F.lit(0))).cast("bigint")
    return agg.select(n.alias("n_classes"), (n <= limit).alias("valid"))


def _value_key(field: T.StructField) -> Column:
    """Text that is equal exactly for equal values of a column (null stays null); long ones by SHA-256, so that
    what is shuffled stays short.  As in Spark's grouping, -0.0 equals 0.0 and NaN equals NaN."""
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        c = (c + F.lit(0.0).cast(field.dataType)).cast("string")
    elif isinstance(field.dataType, T.BinaryType):
        c = F.base64(c)
    elif isinstance(field.dataType, (T.ArrayType, T.StructType)):
        c = F.when(c.isNotNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
    else:
        c = c.cast("string")
    return F.when(F.length(c) <= 64, F.concat(F.lit("="), c)).otherwise(F.concat(F.lit("#"), F.sha2(c, 256)))


def column_uniqueness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Total, non-null and distinct count of every column, exact, in one shuffle.

    Rows become (column number, value key), counted map-side, so a value that holds a third of the rows costs
    one row a task; only each task's distinct keys are shuffled, not the rows once a column.  Of a table without
    rows all counts are 0.  Maps cannot be compared and are an error."""
    cols = columns or df.columns
    fields = [df.schema[c] for c in cols]
    if bad := [f.name for f in fields if isinstance(f.dataType, T.MapType)]:
        raise ValueError(f"map columns have no distinct values: {', '.join(bad)}")
    cells = df.select(F.posexplode(F.array(*[_value_key(f) for f in fields])).alias("_i", "_v"))
    seen = cells.groupBy("_i", "_v").agg(F.count(F.lit(1)).alias("_n")).groupBy("_i").agg(
        F.sum("_n").alias("t"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))).alias("nn"), F.count("_v").alias("d"))
    names = df.sparkSession.createDataFrame(list(enumerate(cols)), "_i int, column_name string")
    zero = F.lit(0).cast("bigint")
    return names.join(F.broadcast(seen), "_i", "left").select(
        "column_name", F.coalesce("t", zero).alias("n_total"), F.coalesce("nn", zero).alias("n_nonnull"),
        F.coalesce("d", zero).alias("n_distinct"))


def unique_int_keys(df: DataFrame) -> DataFrame:
    """Integer columns with total = non-null = distinct, by exact counts."""
    int_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, INT_TYPES)]
    if not int_cols:
        return df.sparkSession.createDataFrame([], "column_name string")
    u = column_uniqueness(df.select(*[F.col(f"`{c}`") for c in int_cols]), int_cols)
    return u.filter((F.col("n_total") == F.col("n_nonnull")) & (F.col("n_nonnull") == F.col("n_distinct"))) \
            .select("column_name")


def table_columns(df: DataFrame) -> DataFrame:
    """Column name, type, and whether it may serve as class / id column."""
    rows = []
    for f in df.schema.fields:
        is_text = isinstance(f.dataType, TEXT_TYPES)
        is_int = isinstance(f.dataType, INT_TYPES)
        rows.append((f.name, f.dataType.simpleString(), is_text or is_int, is_int))
    out = df.sparkSession.createDataFrame(
        rows, "column_name string, data_type string, class_candidate boolean, id_candidate boolean")
    return out.orderBy(F.col("data_type").desc(), "column_name")


def list_tables(spark: SparkSession) -> DataFrame:
    """catalogs/databases and tables visible to the session."""
    rows = []
    for db in spark.catalog.listDatabases():
        try:
            for t in spark.catalog.listTables(db.name):
                rows.append((db.name, t.name, t.tableType))
        except Exception:  # inaccessible database: dropped, as in the reference
            continue
    return spark.createDataFrame(rows, "database string, table_name string, table_type string")


def dedupe_union(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Append ``new`` to ``old`` keeping the first row per key (old rows win).

    Duplicates inside ``new`` keep their smallest row (deterministic; ``min_by`` aggregates
    partially, so a hot key does not land whole in one task).
    """
    fresh = new.join(old.select(key), key, "left_anti")
    cols = [c for c in new.columns if c != key]
    if cols:
        row = F.struct(*[F.col(c) for c in cols])
        fresh = fresh.groupBy(key).agg(F.min_by(row, row).alias("_r")).select(key, "_r.*")
    return old.unionByName(fresh.select(*old.columns))


def read_run(data: DataFrame, rows: DataFrame, header: DataFrame, id_col: str, run_id: int,
             label: str | None = None) -> DataFrame:
    """Data joined to one run's prediction rows and header, ordered by id.

    The header holds one row per run, so it is broadcast; ``rows`` is filtered on the
    partition column first (partition pruning).
    """
    r = rows.filter(F.col("run_id") == run_id)
    h = F.broadcast(header.filter(F.col("run_id") == run_id))
    d = data.drop(label) if label else data
    return (d.join(r, d[id_col] == r["unique_key"], "inner").drop("unique_key")
            .join(h, "run_id", "inner").orderBy(id_col))


def correct_labels(df: DataFrame, corrections: DataFrame, id_col: str, label: str) -> DataFrame:
    """Apply (id, new_label) corrections; untouched rows keep their class."""
    corr = corrections.select(F.col(id_col), F.col("new_label").cast(df.schema[label].dataType))
    return (df.join(corr, id_col, "left")
            .withColumn(label, F.coalesce(F.col("new_label"), F.col(label)))
            .drop("new_label").select(*df.columns))


def rows_by_ids(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id is in ``ids`` (a semi join, not an IN list through the driver)."""
    return df.join(ids.select(id_col), id_col, "left_semi")

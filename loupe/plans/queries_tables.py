"""Registered queries for sources (S), profiling (F) and cleaning/typing (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loupe.functions import clean, split, text
from loupe.operators import profile
from loupe.plans.registry import query
from loupe.sources import tables as S
from loupe.spec import TableSpec
from loupe.operators.typing import infer_types, apply_types

R6 = 6


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, R6)


DOCS = TableSpec(id="doc_id", label="quality", text=("text",), numeric=("n_chars",), categorical=("lang", "source"))
LABELLED_DOCS_SQL = "(SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def docs(spark, sf):
    return S.labelled_documents(spark, sf)


# ---------------------------------------------------------------- S: sources
@query("S1_read_table", f"""
SELECT text, n_chars, lang, source, doc_id, quality FROM {LABELLED_DOCS_SQL}""")
def q_s1(spark, sf):
    return S.read_table(docs(spark, sf), DOCS)


@query("S2_mode_filter_train", f"""
SELECT doc_id, lang, quality FROM {LABELLED_DOCS_SQL}
WHERE NOT (quality IS NULL OR trim(CAST(quality AS VARCHAR)) = '')""")
def q_s2a(spark, sf):
    return S.mode_filter(docs(spark, sf), "quality", train=True, predict=False).select("doc_id", "lang", "quality")


@query("S2_mode_filter_predict", f"""
SELECT doc_id, lang, quality FROM {LABELLED_DOCS_SQL}
WHERE quality IS NULL OR trim(CAST(quality AS VARCHAR)) = ''""")
def q_s2b(spark, sf):
    return S.mode_filter(docs(spark, sf), "quality", train=False, predict=True).select("doc_id", "lang", "quality")


@query("S3_sample_n", """
SELECT o_orderkey, o_orderpriority FROM orders
ORDER BY md5('42' || '|' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100""")
def q_s3(spark, sf):
    return S.sample_n(S.load(spark, sf, "orders"), 100, "o_orderkey", seed=42).select("o_orderkey", "o_orderpriority")


@query("S4_order_by_class", """
SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC NULLS LAST""")
def q_s4(spark, sf):
    return S.order_by_class(S.load(spark, sf, "orders"), "o_orderpriority").select("o_orderkey", "o_orderpriority")


@query("S5_effective_row_limit", f"""
SELECT count(*) AS n_rows, count(*) FILTER (WHERE quality IS NOT NULL) AS n_labelled,
       least(CAST(5000 AS BIGINT), count(*) FILTER (WHERE quality IS NOT NULL)) AS row_limit
FROM {LABELLED_DOCS_SQL}""")
def q_s5(spark, sf):
    return S.effective_row_limit(docs(spark, sf), "quality", limit=5000, predict=False)


@query("S6_row_count", "SELECT count(*) AS n_rows FROM lineitem")
def q_s6(spark, sf):
    return S.row_count(S.load(spark, sf, "lineitem"))


@query("S7_class_distribution", f"""
SELECT coalesce(CAST(quality AS VARCHAR), 'NULL') AS class_value, count(*) AS n_rows
FROM {LABELLED_DOCS_SQL} GROUP BY 1 ORDER BY 1 DESC""")
def q_s7(spark, sf):
    return S.class_distribution(docs(spark, sf), "quality")


@query("S7_class_distribution_lineitem", """
SELECT coalesce(l_returnflag, 'NULL') AS class_value, count(*) AS n_rows FROM lineitem GROUP BY 1 ORDER BY 1 DESC""")
def q_s7b(spark, sf):
    return S.class_distribution(S.load(spark, sf, "lineitem"), "l_returnflag")


@query("S8_can_predict", f"""
SELECT coalesce(bool_or(quality IS NULL OR trim(CAST(quality AS VARCHAR)) = ''), false) AS can_predict
FROM {LABELLED_DOCS_SQL}""")
def q_s8(spark, sf):
    return S.can_predict(docs(spark, sf), "quality")


@query("S9_class_column_valid", """
SELECT CAST(count(DISTINCT o_orderpriority) + max(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_classes,
       count(DISTINCT o_orderpriority) + max(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END) <= 30 AS valid
FROM orders""")
def q_s9(spark, sf):
    return S.class_column_valid(S.load(spark, sf, "orders"), "o_orderpriority")


_ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("S10_column_uniqueness", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS n_total, count({c}) AS n_nonnull, count(DISTINCT {c}) AS n_distinct FROM orders"
    for c in _ORDER_COLS))
def q_s10(spark, sf):
    return S.column_uniqueness(S.load(spark, sf, "orders"), _ORDER_COLS)


@query("S11_unique_int_keys", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name FROM orders HAVING count(*) = count({c}) AND count({c}) = count(DISTINCT {c})"
    for c in ["o_orderkey", "o_custkey"]))
def q_s11(spark, sf):
    return S.unique_int_keys(S.load(spark, sf, "orders"))


_OLD = "o_orderdate < TIMESTAMP '1999-01-01'"
_NEW = "o_orderdate >= TIMESTAMP '1998-01-01'"


@query("S14_dedupe_union", f"""
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE {_OLD}
UNION ALL
SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice FROM orders
WHERE {_NEW} AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE {_OLD})""")
def q_s14(spark, sf):
    o = S.load(spark, sf, "orders")
    old = o.filter(F.expr(_OLD)).select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = o.filter(F.expr(_NEW)).select("o_orderkey", F.lit("N").alias("o_orderstatus"), "o_totalprice")
    return S.dedupe_union(old, new, "o_orderkey")


@query("S18_correct_labels", f"""
SELECT d.doc_id, coalesce(c.new_label, d.quality) AS quality
FROM {LABELLED_DOCS_SQL} d LEFT JOIN (SELECT doc_id, 0 AS new_label FROM labels WHERE toxic = 1) c USING (doc_id)""")
def q_s18(spark, sf):
    d = docs(spark, sf).select("doc_id", "quality")
    corr = S.load(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.lit(0).alias("new_label"))
    return S.correct_labels(d, corr, "doc_id", "quality")


@query("S19_rows_by_ids", """
SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def q_s19(spark, sf):
    ids = S.load(spark, sf, "labels").filter("toxic = 1")
    return S.rows_by_ids(S.load(spark, sf, "documents").select("doc_id", "lang", "n_chars"), ids, "doc_id")


# ---------------------------------------------------------------- F: profiling
_LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("F1_shape", "SELECT count(*) AS n_rows, CAST(11 AS BIGINT) AS n_columns FROM lineitem")
def q_f1(spark, sf):
    return profile.shape(S.load(spark, sf, "lineitem"))


@query("F2_head", "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 20")
def q_f2(spark, sf):
    return profile.head(S.load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_orderkey")


@query("F4_describe", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
    round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50,
    round(quantile_cont({c}, 0.75), 6) AS p75, round(max({c}), 6) AS max FROM lineitem""" for c in _LI_NUM))
def q_f4(spark, sf):
    d = profile.describe(S.load(spark, sf, "lineitem"), _LI_NUM)
    return d.select("column_name", F.col("count").cast("bigint").alias("count"),
                    *[r6(c).alias(c) for c in ["mean", "std", "min", "p25", "p50", "p75", "max"]])


@query("F5_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in _LI_NUM for b in _LI_NUM))
def q_f5(spark, sf):
    return profile.correlation(S.load(spark, sf, "lineitem"), _LI_NUM).select("col_a", "col_b", r6("corr").alias("corr"))


@query("F6_skew", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(skewness({c}), 6) AS skew FROM lineitem" for c in _LI_NUM))
def q_f6(spark, sf):
    return profile.skew(S.load(spark, sf, "lineitem"), _LI_NUM).select("column_name", r6("skew").alias("skew"))


@query("F7_value_counts", "SELECT l_linestatus, count(*) AS n_rows FROM lineitem GROUP BY 1")
def q_f7(spark, sf):
    return profile.value_counts(S.load(spark, sf, "lineitem"), "l_linestatus")


@query("F8_smallest_class_size", """
SELECT CAST(greatest(1, min(n)) AS BIGINT) AS n_min FROM (SELECT c_mktsegment, count(*) AS n FROM customer
WHERE c_mktsegment IS NOT NULL GROUP BY 1)""")
def q_f8(spark, sf):
    return profile.smallest_class_size(S.load(spark, sf, "customer"), "c_mktsegment")


@query("F9_cv_folds", f"""
SELECT n_min, CAST(least(10, floor(n_min - 0.2)) AS BIGINT) AS n_folds FROM (
  SELECT CAST(greatest(1, min(n)) AS BIGINT) AS n_min FROM (
    SELECT quality, count(*) AS n FROM {LABELLED_DOCS_SQL} WHERE quality IS NOT NULL GROUP BY 1))""")
def q_f9(spark, sf):
    return profile.cv_folds_frame(docs(spark, sf), "quality")


@query("F10_lexical_richness", r"""
SELECT CAST(count(*) AS BIGINT) AS n_words, CAST(count(DISTINCT w) AS BIGINT) AS n_terms,
       round(count(DISTINCT w) / count(*), 6) AS ttr
FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents)""")
def q_f10(spark, sf):
    return profile.lexical_richness(S.load(spark, sf, "documents"), "text").select(
        "n_words", "n_terms", r6("ttr").alias("ttr"))


def _stop_table_sql(langs):
    parts = []
    for code in langs:
        parts.append(f"SELECT '{code}' AS lang, unnest({text.sql_string_list(text.stop_words(code))}) AS w")
    return " UNION ".join(parts)


def _f11_sql():
    return rf"""
WITH sw AS ({_stop_table_sql(sorted(text.LANGUAGES))}),
tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM documents),
hits AS (SELECT doc_id, sw.lang, count(*) AS n FROM tok JOIN sw USING (w) GROUP BY 1, 2),
best AS (SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, lang) AS rk FROM hits) WHERE rk = 1)
SELECT d.doc_id, coalesce(b.lang, 'sv') AS detected, d.lang AS lang FROM documents d LEFT JOIN best b USING (doc_id)"""


@query("F11_detect_language", _f11_sql)
def q_f11(spark, sf):
    from loupe.operators.features import detect_language
    d = S.load(spark, sf, "documents")
    return detect_language(d, "doc_id", "text").join(d.select("doc_id", "lang"), "doc_id")


@query("F12_missing_counts", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL {'OR isnan(' + c + ')' if c in ('o_totalprice',) else ''}) AS n_missing, "
    f"count(*) AS n_rows, count(*) FILTER (WHERE {c} IS NULL {'OR isnan(' + c + ')' if c in ('o_totalprice',) else ''}) = count(*) AS all_missing FROM orders"
    for c in _ORDER_COLS))
def q_f12(spark, sf):
    return profile.missing_counts(S.load(spark, sf, "orders"), _ORDER_COLS)


# ---------------------------------------------------------------- P: cleaning and typing
@query("P1_infer_types", r"""
WITH s AS (SELECT CAST(props AS VARCHAR) AS props, CAST(event_type AS VARCHAR) AS event_type FROM events),
flags AS (
  SELECT 'props' AS column_name,
    count(*) FILTER (WHERE props IS NULL OR trim(props) IN ('', 'nan', 'None', 'NaT', '<NA>') OR lower(trim(props)) = 'nan') AS n_missing,
    count(*) FILTER (WHERE NOT (props IS NULL OR trim(props) IN ('', 'nan', 'None', 'NaT', '<NA>') OR lower(trim(props)) = 'nan')
                     AND TRY_CAST(replace(replace(props, ' ', ''), ',', '.') AS DOUBLE) IS NULL) AS n_unparsable,
    count(*) FILTER (WHERE NOT (props IS NULL OR trim(props) IN ('', 'nan', 'None', 'NaT', '<NA>') OR lower(trim(props)) = 'nan')
                     AND regexp_matches(props, '^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d+)?)?$')) AS n_iso
  FROM s
  UNION ALL
  SELECT 'event_type',
    count(*) FILTER (WHERE event_type IS NULL OR trim(event_type) IN ('', 'nan', 'None', 'NaT', '<NA>') OR lower(trim(event_type)) = 'nan'),
    count(*) FILTER (WHERE NOT (event_type IS NULL OR trim(event_type) IN ('', 'nan', 'None', 'NaT', '<NA>') OR lower(trim(event_type)) = 'nan')
                     AND TRY_CAST(replace(replace(event_type, ' ', ''), ',', '.') AS DOUBLE) IS NULL),
    count(*) FILTER (WHERE NOT (event_type IS NULL OR trim(event_type) IN ('', 'nan', 'None', 'NaT', '<NA>') OR lower(trim(event_type)) = 'nan')
                     AND regexp_matches(event_type, '^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}:\d{2}(\.\d+)?)?$'))
  FROM s)
SELECT column_name, CASE WHEN n_unparsable = 0 THEN 'float' ELSE 'float_nan' END AS decision,
       CAST(n_missing AS BIGINT) AS n_missing, CAST(n_unparsable AS BIGINT) AS n_unparsable
FROM flags
UNION ALL SELECT 'event_id', 'float', count(*) FILTER (WHERE event_id IS NULL), CAST(0 AS BIGINT) FROM events
UNION ALL SELECT 'ts', 'ordinal', count(*) FILTER (WHERE ts IS NULL), CAST(0 AS BIGINT) FROM events
UNION ALL SELECT 'user_id', 'float', count(*) FILTER (WHERE user_id IS NULL), CAST(0 AS BIGINT) FROM events
UNION ALL SELECT 'value', 'float', count(*) FILTER (WHERE value IS NULL OR isnan(value)), CAST(0 AS BIGINT) FROM events""")
def q_p1(spark, sf):
    return infer_types(S.load(spark, sf, "events"))


@query("P1_typed_events", """
SELECT event_id, round(value, 6) AS value, datediff('day', DATE '0001-01-01', CAST(ts AS DATE)) + 1 AS ts,
       CAST(user_id AS DOUBLE) AS user_id FROM events""")
def q_p1b(spark, sf):
    ev = S.load(spark, sf, "events").select("event_id", "value", "ts", "user_id")
    typed = apply_types(ev, infer_types(ev), keep=["event_id"])
    return typed.select("event_id", r6("value").alias("value"), "ts", "user_id")


@query("P5_to_ordinal", """
SELECT o_orderkey, datediff('day', DATE '0001-01-01', CAST(o_orderdate AS DATE)) + 1 AS ordinal FROM orders""")
def q_p5(spark, sf):
    return S.load(spark, sf, "orders").select("o_orderkey", clean.to_ordinal("o_orderdate").alias("ordinal"))


_P6_RENDER = """CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
  WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') ELSE strftime(o_orderdate, '%m/%d/%Y') END"""


@query("P6_parse_datetime_multi", f"""
SELECT o_orderkey, txt, try_strptime(txt, ['%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%Y-%m-%d %H:%M:%S.%f', '%d/%m/%Y %H:%M:%S',
  '%d/%m/%Y', '%d/%m/%Y %H:%M:%S.%f', '%m/%d/%Y %H:%M:%S', '%m/%d/%Y', '%m/%d/%Y %H:%M:%S.%f']) AS parsed
FROM (SELECT o_orderkey, {_P6_RENDER} AS txt FROM orders)""")
def q_p6(spark, sf):
    o = S.load(spark, sf, "orders")
    k = F.pmod(F.col("o_orderkey"), F.lit(3))
    txt = (F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
           .when(k == 1, F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"))
           .otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")))
    return o.select("o_orderkey", txt.alias("txt")).select(
        "o_orderkey", "txt", clean.parse_datetime_multi("txt").alias("parsed"))


@query("P7_sanitize_text", r"""
SELECT conv_id, turn, CASE WHEN text IS NULL THEN ''
  WHEN TRY_CAST(trim(text) AS DOUBLE) IS NOT NULL OR regexp_matches(trim(text), '^[+-]?\d+$')
       OR lower(trim(text)) IN ('true', 'false') THEN ''
  ELSE trim(regexp_replace(text, '\s+', ' ', 'g')) END AS clean_text
FROM conversations""")
def q_p7(spark, sf):
    c = S.load(spark, sf, "conversations")
    return c.select("conv_id", "turn", clean.sanitize_text("text").alias("clean_text"))


@query("P8_sanitize_number", """
SELECT e.event_id, 0.0 AS props_num, CAST(datediff('day', DATE '0001-01-01', CAST(e.ts AS DATE)) + 1 AS DOUBLE) AS ts_num,
       round(e.value, 6) AS value_num FROM events e""")
def q_p8(spark, sf):
    e = S.load(spark, sf, "events")
    return e.select("event_id", clean.sanitize_number("props").alias("props_num"),
                    clean.sanitize_number(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ts_num"),
                    F.round(clean.sanitize_number(F.col("value").cast("string")), 6).alias("value_num"))


@query("P10_normalise_key", """
SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice / 100.0, 0) AS BIGINT) AS key FROM lineitem""")
def q_p10(spark, sf):
    li = S.load(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", clean.normalise_key(F.col("l_extendedprice") / 100.0).alias("key"))


@query("P11_clean_labels", """
SELECT DISTINCT trim(CAST(o_orderpriority AS VARCHAR)) AS label FROM orders
WHERE o_orderpriority IS NOT NULL AND trim(CAST(o_orderpriority AS VARCHAR)) <> '' ORDER BY 1""")
def q_p11(spark, sf):
    o = S.load(spark, sf, "orders")
    return (o.select(clean.clean_label("o_orderpriority").alias("label")).filter(F.col("label").isNotNull())
            .distinct().orderBy("label"))


@query("P12_predicates", r"""
SELECT event_id, TRY_CAST(trim(props) AS DOUBLE) IS NOT NULL AS props_is_float,
       regexp_matches(trim(CAST(value AS VARCHAR)), '^[+-]?\d+$') AS value_is_int,
       TRY_CAST(trim(CAST(value AS VARCHAR)) AS DOUBLE) IS NOT NULL AS value_is_float,
       NOT (TRY_CAST(trim(event_type) AS DOUBLE) IS NOT NULL OR regexp_matches(trim(event_type), '^[+-]?\d+$')
            OR lower(trim(event_type)) IN ('true', 'false')) AS type_is_str
FROM events""")
def q_p12(spark, sf):
    e = S.load(spark, sf, "events")
    return e.select("event_id", clean.is_float("props").alias("props_is_float"),
                    clean.is_int("value").alias("value_is_int"), clean.is_float("value").alias("value_is_float"),
                    clean.is_str("event_type").alias("type_is_str"))


@query("P13_hex_base64_encode", r"""
SELECT c_custkey, array_to_string(list_transform(list_filter(string_split_regex(trim(c_name), '\s+'), lambda w: w <> ''),
   lambda w: 'b''' || to_base64(encode(lower(hex(w)))) || ''''), ' ') AS encoded FROM customer""")
def q_p13(spark, sf):
    c = S.load(spark, sf, "customer")
    return c.select("c_custkey", text.hex_base64_encode("c_name").alias("encoded"))


@query("P14_impute_zero", """
SELECT o_orderkey, coalesce(CASE WHEN isnan(o_totalprice) THEN 0.0 ELSE round(o_totalprice, 6) END, 0.0) AS o_totalprice FROM orders""")
def q_p14(spark, sf):
    o = S.load(spark, sf, "orders")
    return o.select("o_orderkey", F.round(clean.impute_zero("o_totalprice"), 6).alias("o_totalprice"))


@query("P15_separate_labelled", f"""
SELECT CASE WHEN quality IS NULL OR trim(CAST(quality AS VARCHAR)) = '' THEN 'unlabelled' ELSE 'labelled' END AS part,
       count(*) AS n_rows FROM {LABELLED_DOCS_SQL} GROUP BY 1""")
def q_p15(spark, sf):
    d = docs(spark, sf)
    part = F.when(clean.is_unlabelled("quality"), "unlabelled").otherwise("labelled")
    return d.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("P16_shuffle_key", f"""
SELECT doc_id, quality, md5('42' || '|' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM {LABELLED_DOCS_SQL}""")
def q_p16(spark, sf):
    d = docs(spark, sf)
    return d.select("doc_id", "quality", split.shuffle_key(42, "doc_id").alias("shuffle_key"))


@query("P17_stratified_split", f"""
SELECT l_returnflag, CASE WHEN {split.sql_hash_unit(42, "md5(l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' || l_suppkey)")} < 0.2
  THEN 'test' ELSE 'train' END AS split, count(*) AS n_rows FROM lineitem GROUP BY 1, 2""")
def q_p17(spark, sf):
    li = S.load(spark, sf, "lineitem")
    k = F.md5(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return (li.select("l_returnflag", split.split_column(42, k, 0.2).alias("split"))
            .groupBy("l_returnflag", "split").agg(F.count(F.lit(1)).alias("n_rows")))


@query("P17_stratified_split_exact", f"""
SELECT quality, CAST(count(*) AS BIGINT) AS n_test FROM (
  SELECT quality, row_number() OVER (PARTITION BY quality ORDER BY u, doc_id) AS rk, count(*) OVER (PARTITION BY quality) AS nc
  FROM (SELECT doc_id, quality, {split.sql_hash_unit(42, 'doc_id')} AS u FROM labels))
WHERE rk <= ceil(nc * 0.2) GROUP BY 1""")
def q_p17b(spark, sf):
    lab = S.load(spark, sf, "labels").select("doc_id", "quality")
    out = split.stratified_split_exact(lab, "doc_id", "quality", 0.2, 42)
    return out.filter(F.col("split") == "test").groupBy("quality").agg(F.count(F.lit(1)).alias("n_test"))


@query("P18_stratified_kfold", f"""
SELECT quality, CAST({split.sql_hash_bits(1, 'doc_id', 1)} % 5 AS INTEGER) AS fold, count(*) AS n_rows
FROM labels GROUP BY 1, 2""")
def q_p18(spark, sf):
    lab = S.load(spark, sf, "labels")
    return (lab.select("quality", split.fold_column(1, "doc_id", 5).alias("fold"))
            .groupBy("quality", "fold").agg(F.count(F.lit(1)).alias("n_rows")))


@query("P19_stratified_sample", f"""
SELECT c_mktsegment, count(*) AS n_rows FROM customer
WHERE {split.sql_hash_unit(7, 'c_custkey', 2)} < 0.3 GROUP BY 1""")
def q_p19(spark, sf):
    c = S.load(spark, sf, "customer")
    return c.filter(split.stratified_sample(7, "c_custkey", 0.3)).groupBy("c_mktsegment").agg(
        F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- P2-P4, P9, S12, F3
_MISSING_SQL = "({c} IS NULL OR trim({c}) IN ('', 'nan', 'None', 'NaT', '<NA>') OR lower(trim({c})) = 'nan')"


@query("P2_is_missing", f"""
SELECT event_id, {_MISSING_SQL.format(c='props')} AS props_missing, {_MISSING_SQL.format(c='event_type')} AS type_missing
FROM events""")
def q_p2(spark, sf):
    e = S.load(spark, sf, "events")
    return e.select("event_id", clean.is_missing("props").alias("props_missing"),
                    clean.is_missing("event_type").alias("type_missing"))


@query("P3_standardise_decimal", """
SELECT event_id, replace(replace(props, ' ', ''), ',', '.') AS props_std FROM events""")
def q_p3(spark, sf):
    e = S.load(spark, sf, "events")
    return e.select("event_id", clean.standardise_decimal("props").alias("props_std"))


@query("P4_iso_date_shape", rf"""
SELECT o_orderkey, regexp_matches(CAST(o_orderdate AS VARCHAR), '{clean.ISO_DATE_PATTERN}') AS date_is_iso,
       regexp_matches(o_orderstatus, '{clean.ISO_DATE_PATTERN}') AS status_is_iso FROM orders""")
def q_p4(spark, sf):
    o = S.load(spark, sf, "orders")
    return o.select("o_orderkey", clean.iso_date_shape("o_orderdate").alias("date_is_iso"),
                    clean.iso_date_shape("o_orderstatus").alias("status_is_iso"))


@query("P9_text_as_string", """
SELECT conv_id, turn, coalesce(CAST(role AS VARCHAR), 'None') AS role, coalesce(CAST(text AS VARCHAR), 'None') AS text
FROM conversations""")
def q_p9(spark, sf):
    c = S.load(spark, sf, "conversations")
    return c.select("conv_id", "turn", clean.text_as_string("role").alias("role"), clean.text_as_string("text").alias("text"))


_SCHEMA_TABLES = ["documents", "labels", "embeddings", "events", "orders"]


@query("S12_table_columns", f"""
SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS position FROM information_schema.columns
WHERE table_name IN ({", ".join(f"'{t}'" for t in _SCHEMA_TABLES)})""")
def q_s12(spark, sf):
    rows = [(t, c, i + 1) for t in _SCHEMA_TABLES for i, c in enumerate(S.load(spark, sf, t).columns)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position bigint")


@query("F3_datatypes")
def q_f3(spark, sf):
    """Spark data type of every column of the given tables (metadata only, no scan)."""
    rows = [(t, f.name, f.dataType.simpleString()) for t in _SCHEMA_TABLES for f in S.load(spark, sf, t).schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")

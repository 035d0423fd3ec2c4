"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loupe.llm.common import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


@query("op8_exact_dedup", r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)""")
def op8_exact_dedup(spark, sf_dir):
    from loupe.llm.exactdedup import exact_dedup
    return exact_dedup(load(spark, sf_dir, "documents"))


@query("op1_simhash_near_dedup")
def op1_simhash_near_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from loupe.llm.simhash import near_duplicates
    found = near_duplicates(load(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op3_license_scan")
def op3_license_scan(spark, sf_dir):
    from loupe.llm.licenses import license_digest, scan_licenses
    return license_digest(scan_licenses(load(spark, sf_dir, "documents")))


@query("op9_mix_sources", r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS HUGEINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source),
w AS (SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap, ((rank - 1) % 3 - 1) * 0.5::DOUBLE AS slope FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rank) AS ord, sum(source_size) OVER () AS words FROM w),
f AS (SELECT *, words - coalesce(sum(cap) OVER (ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
             sum(weight) OVER (ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM o),
l AS (SELECT ord AS level_ord, left_words AS level_words, left_weight AS level_weight FROM f
      WHERE left_words * weight <= cap * left_weight ORDER BY ord LIMIT 1),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, slope,
             CASE WHEN ord < level_ord THEN CAST(cap AS DOUBLE) ELSE CAST(weight * level_words AS DOUBLE) / CAST(level_weight AS DOUBLE) END AS target FROM f, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS BIGINT) AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE CAST(size * ((2 * start + size <= 2 * target)::INT + (2 * (start + source_size) + size <= 2 * target)::INT
                                                + (2 * (start + 2 * source_size) + size <= 2 * target)::INT) AS BIGINT) END AS taken
FROM p""")
def op9_mix_sources(spark, sf_dir):
    from loupe.llm.mixing import mix_totals
    return mix_totals(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op10_token_files")
def op10_token_files(spark, sf_dir):
    from loupe.llm.tokenfile import default_tokenizer, token_files
    return token_files(load(spark, sf_dir, "documents"), default_tokenizer())


@query("op7_warc_archive", """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
g AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS h, max(page_id) OVER (PARTITION BY payload) AS top FROM p)
SELECT page_id, payload_bytes,
       translate(to_base(CAST('0x' || h[1:10] AS BIGINT), 32, 8) || to_base(CAST('0x' || h[11:20] AS BIGINT), 32, 8)
              || to_base(CAST('0x' || h[21:30] AS BIGINT), 32, 8) || to_base(CAST('0x' || h[31:40] AS BIGINT), 32, 8),
              '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM g""")
def op7_warc_archive(spark, sf_dir):
    from loupe.llm.warc import archive
    return archive(load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_exact_top_k", """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def op5_exact_top_k(spark, sf_dir):
    from loupe.llm.topk import exact_top_k
    return exact_top_k(load(spark, sf_dir, "embeddings"))


@query("op6_toxicity")
def op6_toxicity(spark, sf_dir):
    from pyspark.sql import functions as F

    from loupe.llm.toxicity import THRESHOLD, fit_toxicity, held_out, score_toxicity
    docs = load(spark, sf_dir, "documents")
    model = fit_toxicity(docs, load(spark, sf_dir, "labels"))
    return score_toxicity(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op4_line_dedup", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
n AS (SELECT *, list_transform(lines, lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS plain FROM d),
w AS (SELECT doc_id, unnest(range(1, len(plain) - 1)) AS i, plain FROM n WHERE len(plain) >= 3),
k AS (SELECT doc_id, i, plain[i] || chr(10) || plain[i + 1] || chr(10) || plain[i + 2] AS key FROM w),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS place FROM k WHERE key <> chr(10) || chr(10)),
c AS (SELECT doc_id, list_sort(list_distinct(flatten(list([i, i + 1, i + 2])))) AS removed FROM f WHERE place > 1 GROUP BY doc_id)
SELECT d.doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed,
       CASE WHEN removed IS NULL THEN text ELSE coalesce(array_to_string(list_transform(
            list_filter(range(1, len(lines) + 1), lambda i: NOT list_contains(removed, i)), lambda i: lines[i]), chr(10)), '') END AS text
FROM d LEFT JOIN c USING (doc_id)""")
def op4_line_dedup(spark, sf_dir):
    from loupe.llm.linedup import line_dedup
    return line_dedup(load(spark, sf_dir, "documents")).drop("removed")


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark, sf_dir):
    from loupe.llm.packing import pack
    return pack(load(spark, sf_dir, "documents"))


@query("op12_fill_in_middle", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
                  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (SELECT *, CAST(len(lines) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS pre, coalesce(array_to_string(lines[a + 1:b], ''), '') AS mid, coalesce(array_to_string(lines[b + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""")
def op12_fill_in_middle(spark, sf_dir):
    from pyspark.sql import functions as F

    from loupe.llm.fim import fill_in_middle, restore
    made = restore(fill_in_middle(load(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


@query("op11_phrase_collocations", r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
p AS (SELECT doc, lang, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS pno FROM d),
s AS (SELECT doc, lang, pno, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
o AS (SELECT doc, lang, pno, unnest(words) AS w1, generate_subscripts(words, 1) AS pos FROM s),
x AS (SELECT lang, w1, lead(w1, 1) OVER w AS w2, lead(w1, 2) OVER w AS w3 FROM o WINDOW w AS (PARTITION BY doc, pno ORDER BY pos)),
n AS (SELECT lang, count(*) AS n FROM x GROUP BY lang),
f1 AS (SELECT lang, w1, CAST(count(*) AS HUGEINT) AS f FROM x GROUP BY ALL HAVING count(*) >= 10),
f2 AS (SELECT lang, w1, w2, CAST(count(*) AS HUGEINT) AS f FROM x WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, CAST(count(*) AS HUGEINT) AS f FROM x WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT f2.lang, w1 || ' ' || w2 AS phrase, f2.f AS a, l.f AS l, r.f AS r, 1000000 * f2.f * f2.f // (l.f * r.f) AS score
       FROM f2 JOIN f1 l USING (lang, w1) JOIN f1 r ON r.lang = f2.lang AND r.w1 = w2
       WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w1 = f2.w1 AND f3.w2 = f2.w2 AND 100 * f3.f >= 50 * f2.f)
         AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.w2 = f2.w1 AND f3.w3 = f2.w2 AND 100 * f3.f >= 50 * f2.f)),
g AS (SELECT f3.lang, f3.w1 || ' ' || f3.w2 || ' ' || f3.w3 AS phrase, f3.f AS a, l1.f AS l1, r1.f AS r1, l2.f AS l2, r2.f AS r2,
             1000000 * f3.f * f3.f // (l1.f * r1.f) AS s1, 1000000 * f3.f * f3.f // (l2.f * r2.f) AS s2
      FROM f3 JOIN f1 l1 ON l1.lang = f3.lang AND l1.w1 = f3.w1 JOIN f2 r1 ON r1.lang = f3.lang AND r1.w1 = f3.w2 AND r1.w2 = f3.w3
              JOIN f2 l2 ON l2.lang = f3.lang AND l2.w1 = f3.w1 AND l2.w2 = f3.w2 JOIN f1 r2 ON r2.lang = f3.lang AND r2.w1 = f3.w3),
c AS (SELECT * FROM c2 UNION ALL SELECT lang, phrase, a, if(s1 <= s2, l1, l2), if(s1 <= s2, r1, r2), least(s1, s2) FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM c)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score
FROM k JOIN n USING (lang) WHERE rank <= 2000""")
def op11_phrase_collocations(spark, sf_dir):
    from loupe.llm.collocations import collocations
    return collocations(load(spark, sf_dir, "documents"))


@query("op13_jaccard_join")
def op13_jaccard_join(spark, sf_dir):
    from loupe.llm.jaccard import jaccard_components
    return jaccard_components(load(spark, sf_dir, "documents"), shingle=3, percent=90)

"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import bpe, decontaminate, html, licenses, lines, middle, mixing, near, periodic, quality, suffix, toxicity, warc
from vacantia.llm.common import ORACLES, QUERIES, query, table

__all__ = ["ORACLES", "QUERIES"]

FOLDED_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op2_substring_dedup")
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.substring_dedup(table(spark, sf_dir, "documents"))


@query("op3_near_duplicates")
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op4_warc_audit",
    """
    WITH r AS (
        SELECT page_id, ('0x' || md5(coalesce(page_id::VARCHAR, ''))[1:7])::BIGINT % greatest(1, ceil((SELECT count(*) FROM pages) / 512.0)::BIGINT) AS archive,
               concat('WARC/1.0', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), coalesce('WARC-Target-URI: ' || url || chr(13) || chr(10), ''),
                      'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), coalesce(html, ''), chr(13), chr(10), chr(13), chr(10)) AS record
        FROM pages
    ),
    p AS (
        SELECT page_id, archive, strlen(record)::BIGINT AS record_length,
               (sum(strlen(record)) OVER (PARTITION BY archive ORDER BY page_id) - strlen(record))::BIGINT AS record_offset,
               ('0x' || md5('fault ' || coalesce(page_id::VARCHAR, ''))[1:7])::BIGINT % 100 AS kind
        FROM r
    )
    SELECT page_id, archive, record_offset, record_length, CASE WHEN kind = 2 THEN 'missing' ELSE 'changed' END AS fault FROM p WHERE kind < 3
    """,
)
def op4_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.replica_faults(table(spark, sf_dir, "pages"))


@query(
    "op5_decontaminate",
    f"""
    WITH d AS (SELECT doc_id, {FOLDED_WORDS} AS w FROM documents),
    b AS (SELECT item_id, {FOLDED_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
    bw AS (
        SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
    ),
    dw AS (
        SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS x
        FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
    ),
    m AS (SELECT doc_id, item_id, i, k FROM dw JOIN bw USING (k, x)),
    h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY 1),
    t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM m GROUP BY 1)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
    """,
)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


@query("op7_quality_rules")
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_mixture")
def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


@query(
    "op9_line_dedup",
    r"""
    WITH raw AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
        FROM documents
    ),
    l AS (SELECT doc_id, line_no, trim(x, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS line FROM raw),
    w AS (
        SELECT doc_id, line_no, line, len(regexp_extract_all(line, '[^ 	-
]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq
        FROM l WHERE line <> ''
    ),
    c AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY seq)::BIGINT AS upto, sum(words) OVER (PARTITION BY doc_id)::BIGINT AS all_words FROM w),
    r AS (
        SELECT doc_id, seq, upto - words AS before, upto, all_words,
               count(*) OVER (PARTITION BY doc_id ORDER BY upto - words RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS ahead,
               count(*) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 19 PRECEDING AND CURRENT ROW) AS back
        FROM c
    ),
    runs AS (
        SELECT doc_id, seq AS s, ahead AS n FROM r WHERE all_words - before >= 20
        UNION SELECT doc_id, seq - back + 1, back FROM r WHERE upto >= 20
    ),
    a AS (SELECT doc_id, list(line ORDER BY seq) AS ls FROM w GROUP BY 1),
    k AS (SELECT doc_id, s, n, array_to_string(ls[s:s + n - 1], chr(10)) AS x FROM runs JOIN a USING (doc_id)),
    f AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, s) AS copy FROM k),
    g AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS seq FROM f WHERE copy > 1),
    m AS (SELECT doc_id, line_no, words FROM w JOIN g USING (doc_id, seq)),
    o AS (
        SELECT doc_id, count(m.words) AS n_removed_lines, coalesce(sum(m.words), 0)::BIGINT AS n_removed_words,
               coalesce(string_agg(x, chr(10) ORDER BY line_no) FILTER (WHERE m.words IS NULL), '') AS kept
        FROM raw LEFT JOIN m USING (doc_id, line_no) GROUP BY 1
    )
    SELECT doc_id, n_removed_lines, n_removed_words, length(kept)::BIGINT AS n_chars_kept, sha256(kept) AS kept_sha256 FROM o
    """,
)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_dedup(table(spark, sf_dir, "documents"))


@query("op10_licenses")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic.planted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = periodic.with_runs(docs).select("doc_id", "periodic.*")
    best = periodic.longest(F.col("runs"))
    listed = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    codec = bpe.Codec(spark, public_tokenizers.path("word_bpe_49k.json"))
    made = table(spark, sf_dir, "documents").select("doc_id", codec.round_trip("text").alias("made")).select("doc_id", "made.*")
    return made.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query(
    "op13_fill_in_middle",
    r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
               sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
        FROM documents
    ),
    c AS (
        SELECT *, len(u)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
               CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
                    WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
        FROM d
    ),
    p AS (
        SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
               array_to_string(u[greatest(x, y) + 1:n], '') AS s
        FROM c
    )
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
           sha256(t) AS restored_sha256
    FROM p
    """,
)
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fim.*")
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )

"""The registered queries of this subpackage and their SQL. Each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_dedup, decontamination, hard_negatives, html_text, importance_resampling, near_dedup, quality_classifier, quality_rules, sentencepiece, source_mixing, substring_dedup, token_counts, warc
from ._shared import table


def tokenizer_file(name: str) -> Path:
    """A public vocabulary's file: below KNNSCORE_TOKENIZERS if set, else where the installed package has it. Only the driver reads it."""
    if folder := os.environ.get("KNNSCORE_TOKENIZERS"):
        return Path(folder) / name
    import public_tokenizers

    return Path(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model").read_bytes())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return found.select("doc_id", "text", "n_removed_chars", "n_removed", "n_units", spans.alias("spans"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json").read_text())


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(spark, table(spark, sf_dir, "pages"))
    checked = F.when(F.col("digest_ok"), F.col("payload_digest")).otherwise(F.raise_error(F.concat(F.lit("a digest doesn't fit the record of page "), F.col("page_id").cast("string"))))
    return rows.select("page_id", "payload_bytes", checked.alias("payload_digest"), "record_type", "refers_to")


def op9_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_dedup.cut(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vec")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece, op2_substring_dedup, op3_decontamination, op4_quality_classifier, op5_near_dedup, op6_quality_rules, op7_token_counts, op8_warc, op9_byte_dedup, op10_html_text,
        op11_importance_resampling, op12_source_mixing, op13_hard_negatives,
    )
}

SQL = {
    "op2_substring_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)),
placed AS (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(line) - 1 AS line_at FROM lines),
cut AS (SELECT doc_id, i, line, line_at, regexp_extract_all(line, '.*?[.!?][\x20\x09-\x0D]+|.+') AS parts FROM placed),
parts AS (SELECT doc_id, i, line_at, generate_subscripts(parts, 1) AS j, unnest(parts) AS part FROM cut),
sentences AS (
  SELECT doc_id, i, j, part, line_at + sum(length(part)) OVER (PARTITION BY doc_id, i ORDER BY j) - length(part) AS pos,
         regexp_extract_all(lower(part), '[\p{L}\p{N}]+') AS words FROM parts),
units AS (SELECT *, array_to_string(words, ' ') AS unit, len(words) AS n, count(*) OVER (PARTITION BY doc_id, i) = 1 AS alone FROM sentences WHERE len(words) > 0),
held AS (SELECT unit, count(DISTINCT doc_id) AS n_docs FROM units GROUP BY unit),
ranked AS (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, i, j) > 1 AS again FROM units JOIN held USING (unit)),
islands AS (SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i, j) AS island FROM ranked),
judged AS (SELECT *, again AND (sum(n) FILTER (again) OVER (PARTITION BY doc_id, island) >= 8 OR (alone AND n_docs >= 10)) AS gone FROM islands),
rest AS (
  SELECT doc_id, i, coalesce(string_agg(part, '' ORDER BY j) FILTER (NOT coalesce(gone, false)), '') AS line, coalesce(bool_or(gone), false) AS changed
  FROM placed LEFT JOIN (SELECT s.doc_id, s.i, s.j, s.part, u.gone FROM sentences s LEFT JOIN judged u USING (doc_id, i, j)) USING (doc_id, i) GROUP BY doc_id, i),
texts AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT changed OR regexp_matches(line, '[^\x20\x09-\x0D]')), '') AS text FROM rest GROUP BY doc_id),
counts AS (
  SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, sum(length(part)) FILTER (gone) AS n_removed_chars,
         string_agg(CAST(pos AS BIGINT) || '-' || CAST(pos + length(part) AS BIGINT), ',' ORDER BY i, j) FILTER (gone) AS spans FROM judged GROUP BY doc_id)
SELECT doc_id, t.text, CAST(coalesce(n_removed_chars, 0) AS BIGINT) AS n_removed_chars, coalesce(n_removed, 0) AS n_removed, coalesce(n_units, 0) AS n_units, coalesce(spans, '') AS spans
FROM documents LEFT JOIN texts t USING (doc_id) LEFT JOIN counts USING (doc_id)""",
    "op3_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(5, len(w)) AS k, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
docs AS (SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM items) WHERE len(w) >= k)),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id)
SELECT doc_id, item_id, any_value(n) AS n_shingles, count(*) AS n_found, count(*) / any_value(n) AS containment
FROM items JOIN docs USING (k, s) JOIN sizes USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n)""",
    "op8_warc": r"""
SELECT page_id, strlen(html) AS payload_bytes,
       translate(concat(lpad(upper(to_base(CAST('0x' || substr(h, 1, 10) AS BIGINT), 32)), 8, '0'), lpad(upper(to_base(CAST('0x' || substr(h, 11, 10) AS BIGINT), 32)), 8, '0'),
                        lpad(upper(to_base(CAST('0x' || substr(h, 21, 10) AS BIGINT), 32)), 8, '0'), lpad(upper(to_base(CAST('0x' || substr(h, 31, 10) AS BIGINT), 32)), 8, '0')),
                 '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, html, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM (SELECT page_id, coalesce(html, '') AS html FROM pages))""",
    "op11_importance_resampling": r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t),
texts AS (SELECT true AS ours, doc_id, text FROM documents UNION ALL SELECT false, NULL, text FROM benchmark),
words AS (SELECT ours, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
features AS (SELECT ours, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words),
counted AS (SELECT ours, doc_id, f, count(*) AS n FROM features GROUP BY ALL),
coded AS (SELECT f, hex(encode(f)) AS code FROM (SELECT DISTINCT f FROM counted)),
hashed AS (SELECT f, xor(4294967295, list_reduce(list_transform(range(CAST(len(code) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(code, 2 * i + 1, 2) AS BIGINT)),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295)) % 10000 AS bucket FROM coded, tab),
placed AS (SELECT ours, doc_id, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
totals AS (SELECT coalesce(sum(n) FILTER (ours), 0)::DOUBLE AS ss, coalesce(sum(n) FILTER (NOT ours), 0)::DOUBLE AS tt FROM placed),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (ours), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT ours), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM sums, totals),
weights AS (SELECT doc_id, sum(n) AS n, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM placed JOIN gains USING (bucket) WHERE ours GROUP BY doc_id),
drawn AS (SELECT doc_id, CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT)::DOUBLE AS h FROM documents),
scored AS (SELECT doc_id, len(w) >= 20 AS fit, CAST(coalesce(n, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words JOIN drawn USING (doc_id) LEFT JOIN weights USING (doc_id) WHERE ours),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id) AS r FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND r <= 25 * (SELECT count(*) FROM scored WHERE fit) // 100 THEN r END AS rank FROM ranked""",
    "op12_source_mixing": r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
found AS (SELECT source, sum(size) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS number FROM sized GROUP BY source),
weighed AS (SELECT *, CASE number % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM found),
steps AS (SELECT *, row_number() OVER fill AS k, sum(n) OVER fill - n AS full_n, sum(w) OVER fill - w AS full_w FROM weighed WINDOW fill AS (ORDER BY n / w, number ROWS UNBOUNDED PRECEDING)),
shares AS (SELECT k, n, w, (1.5::DOUBLE * (SELECT sum(n) FROM found) - 2 * full_n) / ((SELECT sum(w) FROM weighed) - full_w) AS share FROM steps),
level AS (SELECT arg_min(share, k) AS share FROM shares WHERE w * share <= 2 * n),
targets AS (SELECT source, n, CASE WHEN w * share > 2 * n THEN 2::DOUBLE * n ELSE w * share END AS target,
  (CAST('0x' || substr(sha256('12:' || coalesce('s' || source, '')), 1, 4) AS INTEGER) + 0.5::DOUBLE) / 65536 AS u FROM weighed, level),
placed AS (SELECT doc_id, size, n, target, u, CASE WHEN n > 0 THEN target / n::DOUBLE ELSE 0 END AS each, row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id) AS rank
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(n AS BIGINT) AS source_size, target, CAST(least(floor(rank * each + u) - floor((rank - 1) * each + u), ceil(each)) AS BIGINT) * size AS taken FROM placed""",
    "op13_hard_negatives": r"""
WITH rows AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM rows a, rows b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM pairs WHERE same) WHERE r <= 5)
SELECT * FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
         n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
WHERE rank <= 10""",
}

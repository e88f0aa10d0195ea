"""The queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html_extract, kn_quality, langid, license_scan, line_dedup, mixing, quality_rules, simhash, span_dedup, token_counts, vector_codes, whitening
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_kn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kn_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"), langid.fit(table(spark, sf_dir, "documents")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op10_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_dedup.dedup_spans(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op6 that SQL can express."""
    return op6_quality_rules(spark, sf_dir).drop("llr", "kept")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op9 that SQL can express."""
    return op9_license_scan(spark, sf_dir).drop("labels", "score")


def mixing_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op3 that SQL can express."""
    return op3_mixing(spark, sf_dir).drop("target", "taken")


def whitening_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op13 that SQL can express exactly, a row for each vector."""
    return op13_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


_BLANK = r"\x20\x09-\x0D"
_WORDS = f"regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+')"
_PHRASES = "(VALUES " + ", ".join(f"('{p}', '{label}')" for p, label in license_scan.BASE.items()) + ") p(phrase, label)"
SQL = {
    "quality_base": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^{_BLANK}]') GROUP BY r),
win AS (SELECT r, i, w[i:i + 2] AS x FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
cover AS (SELECT r, count(DISTINCT i + k) AS n FROM again CROSS JOIN (VALUES (0), (1), (2)) o(k) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
  coalesce(cover.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(cover.n, 0) > 50 * len(w) AS base_failed FROM d LEFT JOIN dup USING (r) LEFT JOIN cover USING (r)""",
    "license_base": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
placed AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (SELECT r, i - 1 AS i, label FROM placed, {_PHRASES} WHERE array_to_string(w[i:i + len(string_split(phrase, ' ')) - 1], ' ') = phrase),
found AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM d LEFT JOIN found USING (r)""",
    "mixing_sizes": f"SELECT doc_id, len({_WORDS})::BIGINT AS size, sum(len({_WORDS})) OVER (PARTITION BY source)::BIGINT AS source_size FROM documents",
}


_KEPT = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql() -> str:
    """Every part against every entry, round by round."""
    near = "SELECT v, p, arg_min(e, d * 256 + e) AS e, min(d) AS d FROM (SELECT v, p, e, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS d FROM parts JOIN {book} USING (p)) GROUP BY v, p"
    mean = """SELECT p, e, list(CASE WHEN n > 0 THEN (s - ((s % n) + n) % n) // n ELSE o END ORDER BY i) AS c FROM
  (SELECT p, e, i, c[i] AS o FROM {book}, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i)) LEFT JOIN
  (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM parts JOIN {near} USING (v, p), LATERAL (SELECT unnest(range(1, len(x) + 1)) AS i) GROUP BY p, e, i) USING (p, e, i) GROUP BY p, e"""
    return f"""WITH kept AS (SELECT row_number() OVER () AS v, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings WHERE {_KEPT}),
parts AS MATERIALIZED (SELECT v, vec_id, p, q[p * len(q) // 16 + 1:(p + 1) * len(q) // 16] AS x FROM kept, range(16) r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts JOIN (SELECT v FROM kept ORDER BY vec_id LIMIT 64) USING (v)),
a0 AS MATERIALIZED ({near.format(book="b0")}), b1 AS MATERIALIZED ({mean.format(book="b0", near="a0")}),
a1 AS MATERIALIZED ({near.format(book="b1")}), b2 AS MATERIALIZED ({mean.format(book="b1", near="a1")}),
a2 AS MATERIALIZED ({near.format(book="b2")}),
coded AS (SELECT v, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY v)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM b2) AS codebooks_sha256 FROM kept JOIN coded USING (v)"""


SQL |= {
    "op11_vector_codes": _codes_sql(),
    "whitening_base": f"""WITH x AS (SELECT row_number() OVER () AS v, vec_id, unnest(embedding) AS c, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE {_KEPT}),
y AS (SELECT v, vec_id, i, floor(1024 * c::DOUBLE)::HUGEINT + 100000 AS x FROM x), s AS (SELECT i, sum(x)::HUGEINT AS s, count(*) AS n FROM y GROUP BY i)
SELECT vec_id, any_value(n)::BIGINT AS n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation FROM y JOIN s USING (i) GROUP BY v, vec_id""",
}


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_simhash, op2_html_extract, op3_mixing, op4_decontamination, op5_line_dedup, op6_quality_rules, op7_kn_quality, op8_language_id, op9_license_scan, op10_span_dedup)
    ops += (op11_vector_codes, op12_token_counts, op13_whitening)
    return {f.__name__: f for f in (*ops, quality_base, license_base, mixing_sizes, whitening_base)} | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

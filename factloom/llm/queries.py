"""One query for each operator of this subpackage, over the whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, exact_dedup, filter_audit, html_extract, language_id, line_dedup, ngram_join, packing, quality, secrets, substring_dedup, token_files
from .common import documents, shared_folder

RANKS = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_digests(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.kept_digests(substring_dedup.substring_dedup(documents(spark, sf_dir)))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.line_dedup(documents(spark, sf_dir))
    return done.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(secrets.secret_spans(documents(spark, sf_dir)))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.predict_language(docs, language_id.learn_dictionaries(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    token_files.write_token_files(documents(spark, sf_dir), path, public_tokenizers.path(TOKENIZER), end_id=2)
    return token_files.id_digests(token_files.read_token_files(spark, path))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = quality.train_line_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.quality_rules(docs, model)


def op10_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), end_id=0))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.failed_filters(documents(spark, sf_dir))
    return filter_audit.audit(filter_audit.mask_counts(masks, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_exact_dedup, op2_byte_bpe, op3_substring_dedup, op4_line_dedup, op5_secret_scan,
            op6_ngram_join, op7_language_id, op8_token_files, op9_quality_rules, op10_harmonic_packing,
            op11_token_alignment, op12_html_extraction, op13_filter_audit,
        )
    }


_WORDS = r"[^\x20\x09-\x0D]+"

_OP1 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
r AS (SELECT doc_id, h, row_number() OVER w AS nth, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS c
      FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id))
SELECT doc_id, keep_id, c AS group_size, nth = 1 AS kept, h AS text_sha256 FROM r
"""

_OP3 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(w) - 11)) AS i, w FROM d WHERE len(w) >= 13),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM p),
m AS (SELECT s, min(doc_id) AS low FROM x GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT x.doc_id, unnest(range(x.i, x.i + 13)) AS j FROM x JOIN m USING (s) WHERE x.doc_id > m.low),
a AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, k: NOT list_contains(gone, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

_OP4 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(l) - 1)) AS i, l FROM d WHERE len(l) >= 3),
x AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS s FROM p),
y AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS nth FROM x WHERE regexp_matches(s, '[^\x20\x09-\x0D]')),
g AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS j FROM y WHERE nth > 1),
a AS (SELECT doc_id, list(j) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(l)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN l ELSE list_filter(l, lambda v, k: NOT list_contains(gone, k)) END, chr(10))) AS kept_sha256
FROM d LEFT JOIN a USING (doc_id)
"""

#: Every pair that shares a shingle is compared; components by a recursive query.
_OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g
      FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
k AS (SELECT x, y, p.c = nx.c AND p.c = ny.c AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE p.c >= 0.8 * (nx.c + ny.c - p.c) - 1e-6),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, k.y FROM reach JOIN k ON k.x = reach.y)
SELECT d.doc_id, (SELECT min(y) FROM reach WHERE reach.x = d.doc_id) AS class_id,
       (SELECT count(*) FROM k WHERE k.x = d.doc_id) AS n_links, (SELECT count(*) FROM k WHERE k.x = d.doc_id AND same) AS n_copies
FROM d
"""


#: Every order is followed step by step over the sets of failed filters.
_OP13 = rf"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
lows AS (SELECT t, min(doc_id) AS low FROM t GROUP BY t),
w AS (SELECT doc_id, part, t, low, regexp_extract_all(t, '{_WORDS}') AS w FROM t JOIN lows USING (t)),
lab AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
             || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END
             || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > low THEN 'E' ELSE '' END AS m
      FROM w LEFT JOIN lab ON lab.doc_id = w.doc_id),
m AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY part, m),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT f AS filter_order FROM f UNION ALL SELECT o.filter_order || f.f FROM o JOIN f ON NOT contains(o.filter_order, f.f)),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1:step - 1] AS earlier FROM o, unnest(range(1, 6)) AS u(step) WHERE length(filter_order) = 5),
r AS (SELECT part, filter_order, step, f,
             sum(n) FILTER (NOT hit AND NOT contains(m, f)) AS kept, sum(n) FILTER (NOT hit AND contains(m, f)) AS removed,
             sum(n) FILTER (hit AND contains(m, f)) AS redundant, sum(n) FILTER (m = f) AS unique_fails,
             sum(good) FILTER (NOT hit AND contains(m, f)) AS good_lost, sum(toxic) FILTER (NOT hit AND contains(m, f)) AS toxic_lost
      FROM (SELECT *, len(list_intersect(string_split(m, ''), string_split(earlier, ''))) > 0 AND m <> '' AND earlier <> '' AS hit FROM m, s) GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
       coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
       (sum(coalesce(removed, 0)) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": _OP1, "op3_substring_dedup": _OP3, "op4_line_dedup": _OP4, "op6_ngram_join": _OP6, "op13_filter_audit": _OP13}

"""The numbered queries over the driver's tables, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import context_tree as _tree
from . import dart_minhash as _dart
from . import exact_dedup as _exact
from . import language_id as _language
from . import license_scan as _license
from . import media as _media
from . import mixing as _mixing
from . import packing as _packing
from . import phrases as _phrases
from . import repeats as _repeats
from . import token_counts as _counts
from . import toxicity as _toxicity
from . import whitening as _whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _exact.exact_dedup(_table(spark, sf_dir, "documents"), digest_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _license.scan_licenses(_table(spark, sf_dir, "documents")).drop("phrases")


def op3_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _repeats.remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dart.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = _mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.round("__rate", 9).alias("rate"), F.col("__copies").alias("copies"), F.col("__copy").alias("copy"), F.col("__order").alias("order_key"), "text")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _media.media_columns(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts.count_tokens(_table(spark, sf_dir, "documents"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree.score_documents(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _language.identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_exact_dedup": op1_exact_dedup, "op2_license_scan": op2_license_scan, "op3_repeat_removal": op3_repeat_removal, "op4_mixing": op4_mixing, "op5_media_chunks": op5_media_chunks, "op6_packing": op6_packing, "op7_lm_scores": op7_lm_scores, "op8_token_counts": op8_token_counts, "op9_near_dedup": op9_near_dedup, "op10_toxicity": op10_toxicity, "op11_collocations": op11_collocations, "op12_whitening": op12_whitening, "op13_language_id": op13_language_id, "pipeline": corpus_pipeline.run}

ORACLE: dict[str, str] = {
    "op4_mixing": """
WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (sqrt(n) / sum(sqrt(n)) OVER ()) * sum(n) OVER () / n AS rate FROM c),
d AS (SELECT doc_id, documents.source, text, rate,
             ('0x' || substr(md5('mix-1:' || doc_id), 1, 12))::BIGINT / 281474976710656.0 AS u
      FROM documents JOIN r ON documents.source IS NOT DISTINCT FROM r.source),
k AS (SELECT source, i, sum(exp(-rate + i * ln(rate) - lgamma(i + 1.0))) OVER (PARTITION BY source ORDER BY i) AS step
      FROM r, range(0, 64) t(i)),
m AS (SELECT d.doc_id, count(k.step)::INTEGER AS copies FROM d LEFT JOIN k ON k.source = d.source AND k.step <= d.u GROUP BY d.doc_id)
SELECT doc_id, source, round(rate, 9) AS rate, copies, copy::INTEGER AS copy,
       ('0x' || substr(md5('mix-1/order:' || doc_id || ':' || copy), 1, 12))::BIGINT / 281474976710656.0 AS order_key, text
FROM d JOIN m USING (doc_id), LATERAL (SELECT unnest(range(0, copies)) AS copy)""",
    "op1_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_collocations": """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
f AS MATERIALIZED (SELECT lang, g, len(g) AS len, count(*) AS c
      FROM (SELECT lang, unnest(flatten([[w[i : i + k - 1] FOR i IN range(1, len(w) - k + 2)] FOR k IN range(1, 5)])) AS g FROM p) GROUP BY ALL HAVING count(*) >= 30),
cuts AS (SELECT x.lang, x.g, x.c AS a, l.c AS l, r.c AS r, k, ((2000000::HUGEINT * x.c) // (l.c + r.c))::BIGINT AS score
         FROM (SELECT *, unnest(range(1, len)) AS k FROM f WHERE len > 1) x
         JOIN f l ON l.lang = x.lang AND l.g = x.g[1 : k] JOIN f r ON r.lang = x.lang AND r.g = x.g[k + 1 : x.len]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ AS (SELECT lang, g[i : j] AS g, max(c) AS big
           FROM (SELECT lang, g, c, len, i, unnest(range(i + 1, len + 1)) AS j FROM (SELECT *, unnest(range(1, len)) AS i FROM f WHERE len > 2)) WHERE j - i + 1 < len GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_ i ON i.lang = b.lang AND i.g = b.g WHERE i.big IS NULL OR 100 * i.big < 80 * b.a),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""",
}

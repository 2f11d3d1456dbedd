"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from solvane.llm import decontaminate, flat_tokens, jaccard_join, packing, perspectives, phrases, quality, secrets, token_store, toxicity
from solvane.llm.shared import working_folder

TOXIC_FROM = 0.3
QUALITY_FROM = 0.7
#: Words by which a proximity match's rarest words may stand off their places.
NEAR_SLOP = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat token files of all documents, counted by separator scan."""
    return flat_tokens.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=50256).select("doc_id", "file", "ordinal", "start", "n_tokens", "terminated")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words inside exact occurrences of 13-word phrases of the benchmark, and the items with proximity matches."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=NEAR_SLOP)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.size("proximity_items").cast("long").alias("n_near"),
        F.array_join("proximity_items", ",").alias("near_items"),
    )


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in a token store with a perfect hash index, read back by key."""
    docs, folder = table(spark, sf_dir, "documents"), working_folder(spark, "token-store")
    catalogue = token_store.build_store(docs, folder, tokenizer_path(), end_id=0)
    return token_store.records(spark, folder, catalogue, docs, payload=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 tokens."""
    _, placed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2, size=1024)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _scored(scored: DataFrame, least: float) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents by the clause grammar."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))), TOXIC_FROM)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents by hashed n-gram regression."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _scored(quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"))), QUALITY_FROM)


def op7_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations rendered from each participant's side, as segments with masks."""
    return perspectives.rotated(table(spark, sf_dir, "conversations"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets are alike by 0.85 or more, and each set's number of links."""
    return jaccard_join.similar_components(table(spark, sf_dir, "documents"), width=4, percent=85, count_links=True).select("doc_id", "n_shingles", "component_id", "n_links")


def op9_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts by locally consistent parsing."""
    return phrases.fingerprinted(table(spark, sf_dir, "documents"))


def op10_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, judged by how many sources share them."""
    docs = table(spark, sf_dir, "documents")
    return secrets.digests(secrets.scan(docs, F.col("source"), F.concat_ws("/", "source", "lang")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_decontamination": op2_decontamination,
        "op3_token_store": op3_token_store,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_toxicity": op5_toxicity,
        "op6_quality": op6_quality,
        "op7_perspective_rotation": op7_perspective_rotation,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_phrase_fingerprints": op9_phrase_fingerprints,
        "op10_secret_ownership": op10_secret_ownership,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op7_perspective_rotation": OP7_SQL, "op8_ngram_jaccard_join": OP8_SQL}


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), phrase AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM phrase),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS p
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0), sizes WHERE i + n - 1 <= len(w)
), hits AS (SELECT doc_id, i, phrase.n, item_id FROM places JOIN phrase USING (n, p)),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM hits GROUP BY doc_id),
word AS (SELECT doc_id, i, w[i] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d WHERE len(w) > 0)),
frequency AS (SELECT t, count(*) AS f FROM word GROUP BY t),
term AS (SELECT p, n, o, string_split(p, ' ')[o] AS t FROM (SELECT p, n, unnest(range(1, n + 1)) AS o FROM (SELECT DISTINCT p, n FROM phrase))),
rare AS (SELECT p, n, o, t, row_number() OVER (PARTITION BY p ORDER BY coalesce(f, 0), o) AS k FROM term LEFT JOIN frequency USING (t) QUALIFY k <= 4),
anchor AS (SELECT DISTINCT p, n, doc_id, i - o AS base FROM rare JOIN word USING (t) WHERE k = 1),
close AS (
  SELECT DISTINCT anchor.p, anchor.doc_id FROM anchor JOIN rare ON rare.p = anchor.p JOIN word ON word.doc_id = anchor.doc_id AND word.t = rare.t AND abs(word.i - rare.o - base) <= 2
  GROUP BY anchor.p, anchor.n, anchor.doc_id, base HAVING count(DISTINCT k) = least(anchor.n, 4)
),
near AS (SELECT doc_id, count(DISTINCT item_id) AS n_near, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS near_items FROM close JOIN phrase USING (p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, coalesce(near_items, '') AS near_items
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
"""

OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN role IS NULL OR trim(role) = '' THEN 'unknown' ELSE trim(role) END AS speaker, coalesce(text, '') AS text FROM conversations
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (
  SELECT t.conv_id, perspective, turn, speaker, text,
         CASE WHEN speaker = 'system' THEN '<|im_start|>system' || chr(10) WHEN speaker = perspective THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>user name=' || speaker || chr(10) END AS header
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), s AS (SELECT *, header || text || '<|im_end|>' || chr(10) AS segment FROM r),
o AS (
  SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS position, CAST(sum(length(segment)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end"
  FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text)
)
SELECT conv_id, perspective, position, turn, speaker, header, segment, CAST("end" - length(segment) AS BIGINT) AS start, "end",
       CASE WHEN speaker = perspective THEN CAST("end" - length(segment) + length(header) AS BIGINT) END AS train_start, CASE WHEN speaker = perspective THEN "end" - 1 END AS train_end
FROM o
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), sets AS MATERIALIZED (SELECT doc_id, count(*) AS n, sha256(string_agg(shingle, chr(10) ORDER BY shingle)) AS name FROM s GROUP BY doc_id),
classes AS MATERIALIZED (SELECT name, min(doc_id) AS c, any_value(n) AS n FROM sets GROUP BY name),
own AS MATERIALIZED (SELECT c, n, shingle FROM classes JOIN s ON s.doc_id = c),
links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM own a JOIN own b ON a.shingle = b.shingle AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT c AS v, c AS least FROM classes UNION SELECT ways.b, reach.least FROM reach JOIN ways ON ways.a = reach.v AND ways.b > reach.least),
low AS (SELECT v, min(least) AS component_id FROM reach GROUP BY v),
counted AS (SELECT a AS v, count(*) AS n_links FROM ways GROUP BY a)
SELECT d.doc_id, CAST(coalesce(sets.n, 0) AS BIGINT) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (name) LEFT JOIN low ON low.v = classes.c LEFT JOIN counted ON counted.v = classes.c
"""

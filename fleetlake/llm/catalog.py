"""The registered queries of this subpackage: each operator on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlake.llm import (
    alignment, decontamination, embedding_join, license_scan, line_dedup, merge_replay, ngram_join, quality_crf, source_mixing,
    substring_dedup, token_counts, token_output, whitening,
)
from fleetlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return deco


@register("op5_token_binary")
def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, through wavelet-matrix shards: place, length and checksum of each."""
    return token_output.token_binary(table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


OP6_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT doc_id, pos, line,
           translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM keyed
    WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
    SELECT k.*, r.keeper IS NOT NULL AND r.keeper <> k.doc_id AS dropped
    FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@register("op6_line_dedup", OP6_SQL)
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shared by three documents or more are dropped from all but the largest id."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


@register("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of each document that repeat across documents, and which document keeps them."""
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), component AS (
    SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counted AS (
    SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN component c USING (vec_id) LEFT JOIN counted n USING (vec_id)
"""


@register("op10_embedding_near_dedup", OP10_SQL)
def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of embeddings with a cosine of 0.93 or more inside each label."""
    return embedding_join.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@register("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a conditional random field over its lines."""
    return quality_crf.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and number of links of every document, at a Jaccard similarity of 0.8 on five-word shingles."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def _split_sql(nodes: str, parents: str, name: str) -> str:
    """Siblings of ``nodes`` in order, the full ones among them, and the shares of the others by the rounded line."""
    by = f"PARTITION BY {parents}" if parents else ""
    order = f"{by} ORDER BY room / CAST(weight AS DOUBLE), {name} NULLS FIRST"
    return f"""{nodes}_full AS (
    SELECT *, room * CAST(sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS HUGEINT) <= CAST(weight AS HUGEINT)
        * (budget - coalesce(sum(room) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM {nodes}
), {nodes}_line AS (
    SELECT *, CAST(budget - coalesce(sum(room) FILTER (WHERE is_full) OVER ({by}), 0) AS HUGEINT) AS rest,
           sum(weight) FILTER (WHERE NOT is_full) OVER ({by}) AS open_weight,
           sum(weight) FILTER (WHERE NOT is_full) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached
    FROM {nodes}_full
), {nodes}_share AS (
    SELECT *, CAST(CASE WHEN is_full THEN room
        ELSE rest * reached // open_weight - rest * (reached - weight) // open_weight END AS BIGINT) AS share FROM {nodes}_line
)"""


OP2_SQL = rf"""
WITH docs AS (
    SELECT doc_id, CASE WHEN regexp_matches(source, '[0-9]{{1,9}}$')
             THEN 'domain' || (CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) % 4) ELSE 'other' END AS domain,
           lang, source, md5(coalesce(text, '')) AS text_key,
           len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) AS tokens
    FROM documents
), leaves AS (
    SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM docs GROUP BY ALL
), total AS (
    SELECT CAST(sum(tokens) AS BIGINT) AS budget FROM leaves
), d AS (
    SELECT domain, CAST(sum(tokens) * 4 AS BIGINT) AS room, any_value(budget) AS budget,
           CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS weight
    FROM leaves, total GROUP BY domain
), {_split_sql("d", "", "domain")}, l AS (
    SELECT domain, lang, CAST(sum(n.tokens) * 4 AS BIGINT) AS room, any_value(share) AS budget,
           CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END AS weight
    FROM leaves n JOIN d_share USING (domain) GROUP BY domain, lang
), {_split_sql("l", "domain", "lang")}, s AS (
    SELECT n.domain, n.lang, n.source, n.tokens AS leaf_tokens, n.tokens * 4 AS room, p.share AS budget, 1 AS weight
    FROM leaves n JOIN l_share p ON n.domain = p.domain AND n.lang IS NOT DISTINCT FROM p.lang
), {_split_sql("s", "domain, lang", "source")}, planned AS (
    SELECT *, CASE WHEN leaf_tokens > 0 THEN CAST(share // leaf_tokens AS BIGINT) ELSE 0 END AS epochs FROM s_share
), keyed AS (
    SELECT d.*, p.epochs, p.share - p.epochs * p.leaf_tokens AS left_over,
           md5('2:' || p.epochs || ':' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || text_key) AS key
    FROM docs d JOIN planned p ON d.domain = p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source
), placed AS (
    SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) AS upto,
           sum(tokens) OVER (PARTITION BY domain, lang, source, key) AS in_place,
           count(*) OVER (PARTITION BY domain, lang, source, key) AS n_rows
    FROM keyed
), taken AS (
    SELECT doc_id, domain, lang, source, tokens, epochs + CASE WHEN upto <= left_over THEN 1 ELSE 0 END AS copies,
           CAST(CASE WHEN upto > left_over AND upto - in_place <= left_over THEN (left_over - upto + in_place) // n_rows ELSE 0 END AS BIGINT)
               AS cut_tokens
    FROM placed
)
SELECT * FROM taken WHERE copies > 0 OR cut_tokens > 0
"""


@register("op2_source_mixing", OP2_SQL)
def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a mixture of domains, languages and sources takes: in how many epochs, and cut at which token."""
    return source_mixing.mixed(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w
    FROM documents
    UNION ALL
    SELECT 'b', item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') FROM benchmark
), shingles AS (
    SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s
    FROM words WHERE len(w) >= 5
), sizes AS (
    SELECT id, count(*) AS n FROM shingles WHERE kind = 'b' GROUP BY id
)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(z.n) AS n_shingles, count(*) / any_value(z.n) AS containment
FROM shingles d JOIN shingles b ON d.s = b.s AND d.kind = 'd' AND b.kind = 'b' JOIN sizes z ON z.id = b.id
GROUP BY d.id, b.id HAVING count(*) >= 0.8 * any_value(z.n) - 1e-9
UNION ALL
SELECT DISTINCT d.id, b.id, 1, 1, CAST(1 AS DOUBLE)
FROM (SELECT * FROM words WHERE kind = 'b' AND len(w) BETWEEN 1 AND 4) b JOIN (SELECT * FROM words WHERE kind = 'd') d
  ON contains(' ' || array_to_string(d.w, ' ') || ' ', ' ' || array_to_string(b.w, ' ') || ' ')
"""


@register("op3_benchmark_decontamination", OP3_SQL)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document holds: 0.8 or more of their five-word shingles, or all words in a row of a shorter one."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and greedy longest-match tokens of every document."""
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@register("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of documents that are licence notices, their family, and whether a template confirms it."""
    return license_scan.licences(table(spark, sf_dir, "documents"))


@register("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 16 whitened components of every embedding, fitted on the distinct ones."""
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


@register("op12_tokenizer_alignment")
def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the tokens of two tokenizers for every document, and how often linked ids meet in the corpus."""
    found = alignment.alignments(table(spark, sf_dir, "documents"))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select(*[c for c in found.columns if c != "groups"], digest.alias("groups_sha256"))


@register("op13_merge_replay")
def op13_merge_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document by merge replay, and the bytes that they decode to."""
    found = merge_replay.decode(merge_replay.encode(table(spark, sf_dir, "documents")))
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))

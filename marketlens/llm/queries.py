"""The registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import (
    bpe,
    clusters,
    divergence,
    exact_dedup,
    extraction,
    fingerprints,
    id_files,
    packing,
    pii,
    quality,
    simhash,
    token_counts,
    url_filter,
)
from marketlens.llm.common import read, text_parts
from marketlens.sources.scratch import new_path

# Tokens beyond which a document is marked.
TOKEN_LIMIT = 4096


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    docs = read(spark, directory, "documents")
    pairs = fingerprints.edited_pairs(docs, text_parts(docs))
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprints.as_text(F.col("sketch")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def op5_bpe(spark: SparkSession, directory: str) -> DataFrame:
    import public_tokenizers

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode_documents(read(spark, directory, "documents"), path, public_tokenizers.PATTERN)
    return bpe.decode_ids(encoded, path)


def op6_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    pages, labels = read(spark, directory, "pages"), read(spark, directory, "labels")
    judged = url_filter.judge(pages, labels, document=url_filter.document_of(F.col("url")))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def _op6_level(level: str, prior: str) -> str:
    """SQL for one level of the priors: its counts, the strength of its prior, its posterior means."""
    low, high = url_filter.STRENGTH
    return f"""
{level}_counts AS (SELECT h.{level} AS k, sum(h.n) AS n, sum(h.good) AS good, any_value({prior}) AS prior FROM {level}_in h GROUP BY h.{level}),
{level}_rho AS (SELECT (sum(n * (good / n - prior) * (good / n - prior)) - sum(prior * (1 - prior))) / sum((n - 1) * prior * (1 - prior)) AS rho
 FROM {level}_counts WHERE n > 0),
{level}_strength AS (SELECT CASE WHEN rho > 0 AND isfinite(rho) THEN least(greatest(1 / rho - 1, {low}), {high}) ELSE {high} END AS s FROM {level}_rho),
{level}_mean AS (SELECT k, (good + s * prior) / (n + s) AS mean, n + s AS size FROM {level}_counts, {level}_strength)"""


def _op6_sql() -> str:
    rest = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
    two = "concat(split_part(p.host, '.', -2), '.', split_part(p.host, '.', -1))"
    known = ", ".join(f"'{suffix}'" for suffix in url_filter.SUFFIXES)
    rules = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))

    def first(value) -> str:
        tests = "".join(
            f" WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '{start}') THEN {value(verdict, of + start)}"
            for verdict, of, start in rules
        )
        return f"CASE{tests} END"

    return f"""
WITH rest AS (SELECT page_id, coalesce({rest}, '') AS r FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
outcomes AS (SELECT doc_id, count(*) AS n, count(*) FILTER (quality = 1 AND coalesce(toxic, 0) <> 1) AS good
 FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT p.host, CAST(sum(coalesce(o.n, 0)) AS DOUBLE) AS n, CAST(sum(coalesce(o.good, 0)) AS DOUBLE) AS good,
 CASE WHEN {two} IN ({known}) THEN {two} ELSE split_part(p.host, '.', -1) END AS suffix,
 CASE WHEN NOT contains(p.host, '.') OR p.host IN ({known}) THEN p.host WHEN {two} IN ({known}) THEN concat(split_part(p.host, '.', -3), '.', {two}) ELSE {two} END AS domain
 FROM parsed p LEFT JOIN outcomes o ON o.doc_id = TRY_CAST(nullif(regexp_extract(p.path, '/([0-9]+)[^/]*$', 1), '') AS BIGINT) GROUP BY p.host),
everything AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS mean FROM hosts),
suffix_in AS (SELECT hosts.*, mean AS above FROM hosts, everything),{_op6_level("suffix", "above")},
domain_in AS (SELECT hosts.*, mean AS above FROM hosts JOIN suffix_mean ON k = hosts.suffix),{_op6_level("domain", "above")},
host_in AS (SELECT hosts.*, mean AS above FROM hosts JOIN domain_mean ON k = hosts.domain),{_op6_level("host", "above")}
SELECT page_id, host, path, {first(lambda verdict, rule: f"'{rule}'")} AS rule,
 coalesce({first(lambda verdict, rule: f"'{verdict}'")},
 CASE WHEN mean + {url_filter.DEVIATIONS} * sqrt(mean * (1 - mean) / (size + 1)) < {url_filter.MIN_GOOD} THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed JOIN host_mean ON k = host"""


def op7_quality_classifier(spark: SparkSession, directory: str) -> DataFrame:
    scored = quality.score(read(spark, directory, "documents"))
    return scored.select("doc_id", F.col("_score").alias("score"), F.col("_kept").alias("kept"))


def op8_id_files(spark: SparkSession, directory: str) -> DataFrame:
    path = new_path(spark, "ids")
    id_files.write_ids(read(spark, directory, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return id_files.read_ids(spark, path)


OP9_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n"""


def op9_exact_dedup(spark: SparkSession, directory: str) -> DataFrame:
    groups = exact_dedup.exact_groups(read(spark, directory, "documents"), keep="max")
    return groups.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op2_token_counts(spark: SparkSession, directory: str) -> DataFrame:
    counted = token_counts.token_counts(read(spark, directory, "documents"), vocabulary("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op3_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack(read(spark, directory, "documents"), vocabulary("byte_bpe_50k.json"))


def op4_simhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    groups = simhash.near_groups(read(spark, directory, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op10_pii(spark: SparkSession, directory: str) -> DataFrame:
    found = pii.find(read(spark, directory, "documents"))
    counts = [pii.count_of(F.col("spans"), kind.name).alias(f"n_{kind.name}") for kind in pii.KINDS]
    base = F.sha2(pii.joined(pii.base_only(F.col("spans"))), 256)
    spans, scores = pii.joined(F.col("spans")).alias("spans"), pii.scores(F.col("spans")).alias("scores")
    return found.select("doc_id", *counts, base.alias("base_sha256"), spans, scores)


def op11_source_divergence(spark: SparkSession, directory: str) -> DataFrame:
    return divergence.audit(read(spark, directory, "documents"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
words AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS word FROM d),
w AS (SELECT r, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM words),
kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term),
cells AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN kept k ON k.lang = g.lang
 LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s)::HUGEINT AS p
 FROM cells WINDOW s AS (PARTITION BY lang, source)),
totals AS (SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s)::HUGEINT AS q
 FROM totals WINDOW s AS (PARTITION BY lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
 WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
 LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


def op12_centroid_clusters(spark: SparkSession, directory: str) -> DataFrame:
    return clusters.with_inertia(*clusters.cluster(read(spark, directory, "embeddings")))


def _op12_sql() -> str:
    def assigned(i: int) -> str:
        return f"""
near{i} AS (SELECT c.r, m.k, sum((c.x - m.x) * (c.x - m.x)) AS distance FROM c JOIN m{i} m ON m.d = c.d GROUP BY c.r, m.k),
best{i} AS (SELECT r, k, distance FROM near{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, k) = 1)"""

    def moved(i: int) -> str:
        return f"""
sums{i} AS (SELECT b.k, c.d, sum(c.x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM best{i} b JOIN c ON c.r = b.r GROUP BY b.k, c.d),
m{i + 1} AS (SELECT o.k, o.d, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), o.x) AS x FROM m{i} o LEFT JOIN sums{i} n ON n.k = o.k AND n.d = o.d)"""

    rounds = ",".join(assigned(i) + "," + moved(i) for i in range(clusters.ROUNDS))
    last = clusters.ROUNDS
    return f"""
WITH every AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings),
parts AS (SELECT r, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM every WHERE len(embedding) = {clusters.DIMENSIONS}),
usable AS (SELECT r FROM parts GROUP BY r HAVING bool_and(x IS NOT NULL AND isfinite(x))),
c AS (SELECT r, d, CAST(floor({clusters.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts WHERE r IN (FROM usable)),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || coalesce(vec_id::VARCHAR, ''))) - 1 AS k FROM every WHERE r IN (FROM usable)),
m0 AS (SELECT f.k, c.d, c.x FROM first f JOIN c ON c.r = f.r WHERE f.k < {clusters.CLUSTERS}),{rounds},{assigned(last)},
digests AS (SELECT k, sha256(string_agg(x::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM m{last} GROUP BY k)
SELECT e.vec_id, CAST(b.k AS INTEGER) AS cluster, CAST(b.distance AS BIGINT) AS distance,
 CAST(sum(b.distance) OVER (PARTITION BY b.k) AS BIGINT) AS cluster_inertia, CAST(sum(b.distance) OVER () AS BIGINT) AS inertia, g.centroid_sha256
FROM best{last} b JOIN every e ON e.r = b.r JOIN digests g ON g.k = b.k"""


def op13_html_text(spark: SparkSession, directory: str) -> DataFrame:
    found = extraction.extract(read(spark, directory, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {
    query.__name__: query
    for query in (
        op1_fingerprints,
        op2_token_counts,
        op3_best_fit_packing,
        op4_simhash_near_dedup,
        op5_bpe,
        op6_url_filter,
        op7_quality_classifier,
        op8_id_files,
        op9_exact_dedup,
        op10_pii,
        op11_source_divergence,
        op12_centroid_clusters,
        op13_html_text,
    )
}
ORACLES = {
    "op6_url_filter": _op6_sql(),
    "op9_exact_dedup": OP9_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_centroid_clusters": _op12_sql(),
}

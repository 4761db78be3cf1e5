"""The opN_ queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterjobs.llm.ball_tree import top_k
from rasterjobs.llm.decontamination import contaminated
from rasterjobs.llm.hard_negatives import mine
from rasterjobs.llm.language import language_of_all
from rasterjobs.llm.line_crf import document_quality
from rasterjobs.llm.line_dedup import dedup_lines
from rasterjobs.llm.minhash import near_duplicates
from rasterjobs.llm.mixing import mix
from rasterjobs.llm.packing import digest, pack
from rasterjobs.llm.quality_rules import quality_rules
from rasterjobs.llm.secrets import secret_spans
from rasterjobs.llm.warc_zip import archived
from rasterjobs.llm.whitening import whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op2_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_of_all(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op6_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(_table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(_table(spark, sf_dir, "embeddings"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return mine(_table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def whitening_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op11."""
    return op11_whitening(spark, sf_dir).select("vec_id", "component", "n", "deviation")


def rules_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op4."""
    return op4_quality_rules(spark, sf_dir).drop("kept", "llr")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op7."""
    return op7_mixing(spark, sf_dir).drop("taken")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of op8."""
    return op8_secrets(spark, sf_dir).drop("spans")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_ball_tree": op2_ball_tree,
    "op3_language": op3_language,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_warc_zip": op6_warc_zip,
    "op7_mixing": op7_mixing,
    "op8_secrets": op8_secrets,
    "op9_minhash": op9_minhash,
    "op10_line_crf": op10_line_crf,
    "op11_whitening": op11_whitening,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_decontamination": op13_decontamination,
    "whitening_base": whitening_base,
    "rules_base": rules_base,
    "mix_targets": mix_targets,
    "secrets_base": secrets_base,
}

_OP2 = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (
  SELECT vec_id, min({'n': len(v), 'v': v}).v AS v FROM q WHERE vec_id % 50 = 0 GROUP BY 1
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 5
"""

#: SHA-1 in base32: eight groups of five hexadecimal digits, each of which holds four base32 digits.
_OP6 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, h, min(page_id) OVER (PARTITION BY h) AS first,
    list_transform(range(8), lambda i: CAST('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS g FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((g[CAST(j // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (j % 4) AS INTEGER)) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM d
"""

_OP9 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.c + q.c - k)
), e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
cc(id, lab) USING KEY (id) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT e.x, min(o.lab) FROM e JOIN recurring.cc o ON o.id = e.y JOIN recurring.cc m ON m.id = e.x WHERE o.lab < m.lab GROUP BY e.x
)
SELECT cc.id AS doc_id, coalesce(n.c, 0) AS n_shingles, cc.lab AS component_id, cc.id = cc.lab AS kept
FROM cc LEFT JOIN n ON n.doc_id = cc.id
"""

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_RULES = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
p AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
d AS (SELECT doc_id, g FROM p GROUP BY 1, 2 HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM p JOIN d USING (doc_id, g), range(5) x(k) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
c AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c
"""

#: The level at which sources stop: sources by rising cap per weight, the first k stopped, the rest sharing what is left.
_MIX = f"""
WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source IS NULL, source) AS place FROM d GROUP BY 1),
w AS (SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight, 1.5e0 * sum(words) OVER () AS total FROM s),
r AS (SELECT *, 2e0 * words / weight AS full_at, row_number() OVER (ORDER BY 2e0 * words / weight, place) AS k FROM w),
v AS (SELECT *, (total - 2 * (sum(words) OVER (ORDER BY k) - words)) / (sum(weight) OVER () - sum(weight) OVER (ORDER BY k) + weight) AS level FROM r),
x AS (SELECT arg_min(level, k) FILTER (level <= full_at) AS level FROM v)
SELECT doc_id, size, words AS source_size, CAST(CASE WHEN x.level * weight > 2 * words THEN 2 * words ELSE x.level * weight END AS DOUBLE) AS target
FROM d JOIN v ON v.source IS NOT DISTINCT FROM d.source, x
"""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_PARTS = " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{kind}' AS kind, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS x FROM d" for k, (kind, p) in enumerate({"assign": _ASSIGN, "access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}.items()))
_SECRETS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ({_PARTS}),
p AS (SELECT doc_id, k, kind, x, g, unnest(range(1, len(x) + 1)) AS i FROM m WHERE len(x) > 0),
s AS (SELECT doc_id, k, kind, x[i] AS y, CAST(list_sum(list_transform(g[1:i], lambda q: length(q))) + coalesce(list_sum(list_transform(x[1:i - 1], lambda q: length(q))), 0) AS BIGINT) AS s FROM p),
f AS (SELECT *, s + length(y) AS e FROM s WHERE k <> 0 OR length(regexp_extract(y, '{_ASSIGN}', 2)) >= 8)
SELECT d.doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k), '')) AS base_sha256
FROM d LEFT JOIN f USING (doc_id) GROUP BY 1
"""

#: All components of the given vectors have variance.
_WHITENING = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), e AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM x),
s AS (SELECT i, sum(x) AS s, count(*) AS n FROM e GROUP BY 1),
d AS (SELECT vec_id, n, CAST(sum((n * x - s) * (n * x - s)) AS BIGINT) AS deviation FROM e JOIN s USING (i) GROUP BY 1, 2)
SELECT vec_id, CAST(k AS INTEGER) AS component, n, deviation FROM d, range(1, 33) r(k)
"""

_OP12 = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), a AS (
  SELECT vec_id, min({'label': label, 'n': len(v), 'v': v}) AS m FROM q WHERE vec_id % 100 = 0 GROUP BY 1
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, b.label = m.label AS same, CAST(list_inner_product(m.v, b.v) AS BIGINT) AS score
  FROM a JOIN q b ON a.vec_id <> b.vec_id AND m.n = len(b.v)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS k FROM s WHERE same
), n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.k ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 30 * p.score AND 90 * p.score WHERE p.k <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

_PLAIN = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP13 = f"""
WITH i AS (SELECT item_id, {_PLAIN} AS ws FROM benchmark WHERE item_id IS NOT NULL),
r AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m, array_to_string(ws[p:p + least(10, len(ws)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS row_id, doc_id, {_PLAIN} AS ws FROM documents),
g AS (SELECT row_id, p, m, array_to_string(ws[p:p + m - 1], ' ') AS g FROM (SELECT row_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS p FROM d, (SELECT DISTINCT m FROM r) WHERE len(ws) >= m)),
h AS (SELECT row_id, p, m, item_id FROM g JOIN r USING (g, m)),
c AS (SELECT row_id, count(DISTINCT p + k) AS n_hit FROM (SELECT DISTINCT row_id, p, m FROM h), range(10) x(k) WHERE k < m GROUP BY 1),
t AS (SELECT row_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT row_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (row_id) LEFT JOIN t USING (row_id)
"""

ORACLES: dict[str, str] = {"whitening_base": _WHITENING, "op12_hard_negatives": _OP12, "op13_decontamination": _OP13, "op2_ball_tree": _OP2, "op6_warc_zip": _OP6, "op9_minhash": _OP9, "rules_base": _RULES, "mix_targets": _MIX, "secrets_base": _SECRETS}

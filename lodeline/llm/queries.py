"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodeline.llm.chat_format import format_chats
from lodeline.llm.common import table
from lodeline.llm.decontamination import contaminated
from lodeline.llm.exact_dedup import exact_groups
from lodeline.llm.fill_middle import fill_in_middle, fingerprints
from lodeline.llm.html_extract import extract_pages
from lodeline.llm.jaccard_join import similar_groups
from lodeline.llm.license_scan import scan_licenses
from lodeline.llm.packing import pack_documents
from lodeline.llm.prefix_trie import conversation_trie
from lodeline.llm.quality_rules import fit_rules, judge
from lodeline.llm.sharding import SHARDS, place
from lodeline.llm.toxicity import fit_model, score
from lodeline.llm.warc import archive_pages, asked_blocks, read_back


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [f"shard-{k:05d}" for k in range(SHARDS)]
    return place(table(spark, sf_dir, "documents").select("doc_id", "text"), names).select("doc_id", "slot", "shard")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit_model(docs, table(spark, sf_dir, "labels")))


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    _, directory = archive_pages(spark, pages)
    return read_back(asked_blocks(pages.select("url"), directory)).drop("url", "payload")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(fill_in_middle(table(spark, sf_dir, "documents")))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_sharding": op2_sharding,
    "op3_html_extraction": op3_html_extraction,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_toxicity": op6_toxicity,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op8_warc"] = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
         min(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS first
  FROM pages
), d AS (
  SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(hex, (i + 1)::BIGINT, 1)) - 1) AS x FROM p
)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((16 * x[(5 * i) // 4 + 1] + x[(5 * i) // 4 + 2]) >> (3 - (5 * i) % 4)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""

ORACLE_SQL["op7_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
  FROM w
), e AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
  GROUP BY ALL HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), r AS (
  SELECT doc_id, doc_id AS m FROM s UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.doc_id
)
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY 1) c ON c.doc_id = s.doc_id
"""

ORACLE_SQL["op13_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

ORACLE_SQL["op11_fill_in_middle"] = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
  SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS b,
    ('0x' || substr(x, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(x, 25, 8))::BIGINT % 100 AS h4
  FROM d
), f AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), o AS (
  SELECT *, substr(t, 1, lo) AS p, substr(t, lo + 1, hi - lo) AS m, substr(t, hi + 1) AS s FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM o
"""

ORACLE_SQL["op12_conversation_prefix_trie"] = r"""
WITH o AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST,
    substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32)) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT c.conv_id, c.t, r.t AS head, (list_reduce(list_concat([4294967295], list_transform(string_split(c.conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) & 3) AS h
  FROM o c LEFT JOIN o r ON r.conv_id = c.conv_id - c.conv_id % 20
), b AS (
  SELECT conv_id, list_concat(coalesce(head[1:3 - h], []), t[4 - h:]) AS t FROM h
), p AS (
  SELECT conv_id, len(t) AS l, unnest(range(len(t) + 1)) AS depth, t FROM b
), m AS (
  SELECT conv_id, l, depth, t[1:depth] AS k, t[1:depth - 1] AS up,
    CASE WHEN depth > 0 THEN len(regexp_extract_all(t[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM p
), n AS (
  SELECT depth, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (l = depth), '')) AS ends_sha256
  FROM m GROUP BY depth, k
), d AS (
  SELECT a.conv_id, a.depth, a.n_convs, a.w, a.ends_sha256, b.conv_id AS parent_conv_id FROM n a LEFT JOIN n b ON b.depth = a.depth - 1 AND b.k = a.up AND a.depth > 0
), c AS (
  SELECT d.*, coalesce(x.n, 0) AS n_children FROM d LEFT JOIN (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n FROM d WHERE depth > 0 GROUP BY ALL) x USING (conv_id, depth)
), s AS (
  SELECT a.conv_id, a.depth, sum((b.n_convs - 1) * b.w)::BIGINT AS saved_tokens, count(*) FILTER (b.n_children = 0) AS n_leaves
  FROM (SELECT n.conv_id, n.depth, u.conv_id AS top, u.depth AS at FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth JOIN n u ON u.depth = m.depth AND u.k = m.k AND n.depth >= u.depth AND m.k = n.k[1:m.depth]) y
  JOIN c b ON b.conv_id = y.conv_id AND b.depth = y.depth JOIN c a ON a.conv_id = y.top AND a.depth = y.at GROUP BY ALL
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM c JOIN s USING (conv_id, depth)
"""

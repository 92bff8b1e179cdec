"""The registered queries of this subpackage, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_groups
from .langid import identify_languages
from .license_scan import scan_licenses
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality import judge_quality
from .ranked_search import search_documents
from .runtime import table
from .suffix_dedup import remove_repeats
from .token_counts import count_tokens
from .url_filter import UrlRule, judge_urls
from .whitening import whiten_embeddings


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary file is; every machine has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path(name)


URL_RULES = (
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
)


#: Target weights of the mixture; a source that is not named has ``OTHER``.
TARGETS = {"src0": 10.0, "src5": 30.0, "src9": 5.0, "src13": 0.5}
OTHER = 3.0


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), weights=TARGETS, other=OTHER)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def document_path() -> Column:
    """A place for a document in a tree of its source: files of 1000 and of 100 ids share directories."""
    doc = F.col("doc_id")
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(doc / 1000).cast("string"), F.floor(doc / 100).cast("string"), F.concat(doc.cast("string"), F.lit(".txt")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), document_path())


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_url_filter,
        op3_quality_rules,
        op4_pack_documents,
        op5_license_scan,
        op6_near_dedup,
        op7_exact_dedup,
        op8_line_dedup,
        op9_language_id,
        op10_suffix_dedup,
        op11_ranked_search,
        op12_token_counts,
        op13_embedding_whitening,
    )
}

WHITE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": f"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(source, '') AS source, length(coalesce(text, ''))::BIGINT AS n_chars, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents
), placed AS (
  SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_char FROM base
), weights AS (
  SELECT source, CASE source {" ".join(f"WHEN '{k}' THEN {v}" for k, v in TARGETS.items())} ELSE {OTHER} END::DOUBLE AS w FROM base GROUP BY source
), frame AS (
  SELECT greatest(1000, ceil(round(20 * sum(w ORDER BY source) / min(w), 6)))::BIGINT AS f FROM weights
), beyond AS (
  SELECT source, greatest(f * w / (SELECT sum(w ORDER BY source) FROM weights) - 1, 0) AS b FROM weights, frame
), quotas AS (
  SELECT source, (f - (SELECT count(*) FROM weights)) * b / (SELECT sum(b ORDER BY source) FROM beyond) AS exact, f FROM beyond, frame
), shares AS (
  SELECT source, 1 + floor(exact)::INT + CASE WHEN row_number() OVER (ORDER BY floor(exact) - exact, source)
    <= f - (SELECT count(*) + sum(floor(exact))::INT FROM quotas) THEN 1 ELSE 0 END AS share FROM quotas
), lists AS (
  SELECT list(source ORDER BY source) AS names, list(share ORDER BY source) AS shares FROM shares
), edf AS (
  SELECT -1 AS slot, list_transform(shares, lambda x: 0) AS done, 0 AS pick, 0 AS nth FROM lists
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p, done[p] FROM (
    SELECT e.slot, e.done, list_aggregate(list_transform(range(1, len(shares) + 1), lambda i: CASE
      WHEN done[i] < shares[i] AND done[i] * f // shares[i] <= slot + 1
      THEN (((done[i] + 1) * f + shares[i] - 1) // shares[i]) * 100000 + i ELSE NULL END), 'min') % 100000 AS p
    FROM (SELECT e.slot, e.done, l.shares, f FROM edf e, lists l, frame WHERE e.slot < f - 1) e)
), schedule AS (
  SELECT l.names[pick] AS source, l.shares[pick] AS share, nth, slot FROM edf, lists l WHERE slot >= 0
), blocks AS (
  SELECT p.*, s.share, at_char // 65536 AS block, (at_char // 65536) // s.share AS frame_no, (at_char // 65536) % s.share AS nth
  FROM placed p JOIN shares s USING (source)
)
SELECT doc_id, b.source, n_chars, block, at_char - block * 65536 AS block_offset, frame_no * f + b.nth * f // b.share AS release,
  frame_no * f + (b.nth * f + f + b.share - 1) // b.share AS deadline, frame_no * f + s.slot AS slot
FROM frame, blocks b JOIN schedule s ON s.source = b.source AND s.nth = b.nth""",
    "op2_url_filter": """
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split
), rules AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) r(rule_host, rule_path, rule_verdict)
), fits AS (
  SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id""",
    "op6_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || coalesce(w[i + 1], '') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT l.y, r.root FROM reach r JOIN both_ways l ON l.x = r.node
), component AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents LEFT JOIN sizes USING (doc_id) JOIN component ON node = doc_id""",
    "op7_exact_dedup": r"""
WITH norm AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM norm""",
    "op8_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, n, line, translate(trim(line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents)
), common AS (
  SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.*, c.key IS NOT NULL AND l.doc_id <> c.holder AS gone FROM lines l LEFT JOIN common c ON c.key = l.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id""",
    "op11_ranked_search": r"""
WITH terms AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), corpus AS (
  SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS total FROM terms WHERE len(t) > 0
), asked AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM terms) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM postings, corpus GROUP BY term, n_docs
), scores AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total))))::BIGINT AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), corpus GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM scores WHERE score > 0) WHERE rank <= 10""",
}

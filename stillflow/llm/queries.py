"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stillflow.llm import ann, lm_score, toxicity, url_filter
from stillflow.llm.common import held_out, table
from stillflow.llm.fingerprints import fingerprints
from stillflow.llm.html_text import extract
from stillflow.llm.mixing import mix
from stillflow.llm.near_dup import near_duplicates
from stillflow.llm.packing import pack_documents
from stillflow.llm.token_counts import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query()
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


@query()
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


@query()
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query()
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query()
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out("doc_id", toxicity.FOLDS, toxicity.HELD_OUT).alias("held_out"), "score", "predicted")


@query()
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


@query(
    r"""WITH sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM sizes GROUP BY source),
caps AS (SELECT *, ([3, 1, 2])[k % 3 + 1]::DOUBLE AS weight, 2.0e0 * source_size AS cap FROM sources),
levels AS (SELECT *, cap / weight AS level, coalesce(sum(cap) OVER w, 0.0e0) AS before_cap, coalesce(sum(weight) OVER w, 0.0e0) AS before_weight FROM caps WINDOW w AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
totals AS (SELECT 1.5e0 * sum(source_size)::DOUBLE AS budget, sum(weight) AS weight FROM caps),
filled AS (SELECT l.*, t.budget, t.weight AS all_weight, l.before_cap + l.level * (t.weight - l.before_weight) <= t.budget AS is_full FROM levels l, totals t),
rest AS (SELECT (any_value(budget) - coalesce(sum(cap) FILTER (is_full), 0.0e0)) / (any_value(all_weight) - coalesce(sum(weight) FILTER (is_full), 0.0e0)) AS level FROM filled),
targets AS (SELECT f.source, f.source_size, f.k, floor(f.budget)::BIGINT AS budget, CASE WHEN f.is_full THEN f.cap ELSE least(f.weight * r.level, f.cap) END AS target FROM filled f, rest r),
queues AS (SELECT s.doc_id, s.size, t.*, coalesce(sum(s.size) OVER (PARTITION BY t.k ORDER BY md5('9:' || s.doc_id || ':' || s.size), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
  FROM sizes s JOIN targets t ON t.source IS NOT DISTINCT FROM s.source),
passes AS (SELECT *, place + unnest([0, 1]) * source_size AS start FROM queues WHERE size > 0),
begun AS (SELECT *, least(size, floor(target - start)::BIGINT) AS until FROM passes WHERE start < target),
parts AS (SELECT *, until AS words, until AS stop FROM begun UNION ALL SELECT *, least(size - until, 1), until + least(size - until, 1) FROM begun UNION ALL SELECT *, size - until - least(size - until, 1), size FROM begun),
sendings AS (SELECT doc_id, k, place, budget, words, (start + stop) / target AS finish FROM parts WHERE words > 0),
sent AS (SELECT *, coalesce(sum(words) OVER (ORDER BY finish, k, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sendings),
taken AS (SELECT doc_id, sum(least(words, greatest(0, budget - before)))::BIGINT AS taken FROM sent GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0)::BIGINT AS taken FROM queues q LEFT JOIN taken t ON t.doc_id = q.doc_id"""
)
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query(
    r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.c >= 75 * (x.n + y.n - c.c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, far) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, l.b FROM reach r JOIN both_ways l ON l.a = r.far),
least AS (SELECT id, min(far) AS component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least m ON m.id = d.doc_id"""
)
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")

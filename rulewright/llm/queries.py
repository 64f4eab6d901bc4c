"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, decontam, divergence, html, lattice, lines, minhash, packing, quality, secrets, urlfilter, warc
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    clash = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", clash), (-7, 1, "assistant", clash)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.render(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False, added=packing.tokenizer_file())


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_back(warc.write(table(spark, sf_dir, "pages")))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).withColumn("patterns", F.array_join("patterns", " "))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op") and callable(f)}


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_HOSTS = ", ".join(f"({_text(h)}, {_text(p)}, {_text(v)})" for h, p, v in urlfilter.HOST_RULES)
_PATTERNS = ", ".join(f"({_text(p)}, {_text(urlfilter.to_regex(p))})" for p in urlfilter.PATTERN_RULES)

#: DuckDB SQL by query. The urls' SQL tries every pattern on every url.
ORACLE_SQL: dict[str, str] = {
    "op8_warc": """WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages), q AS (SELECT page_id, url, strlen(html)::bigint AS payload_bytes, sha256(html) AS payload_digest FROM p),
  r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original FROM q)
  SELECT page_id, url, payload_bytes, payload_digest, CASE WHEN original = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN original <> page_id THEN original END AS refers_to FROM r""",
    "op11_source_divergence": divergence.SQL,
    "op12_centroid_clustering": centroids.sql(),
    "op10_url_filters": f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
  u AS (SELECT DISTINCT url, translate(url, '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS low, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM p),
  h AS (SELECT url, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict FROM u JOIN (VALUES {_HOSTS}) r(rh, rp, rv) ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY url),
  f AS (SELECT url, string_agg(pattern, ' ' ORDER BY pattern) AS patterns, bool_or(starts_with(pattern, '@@')) AS allowed FROM u JOIN (VALUES {_PATTERNS}) r(pattern, regex) ON regexp_matches(low, regex) GROUP BY url)
  SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN allowed THEN 'allow' WHEN NOT allowed THEN 'block' END, 'allow') AS verdict, patterns FROM p JOIN u USING (url) LEFT JOIN h USING (url) LEFT JOIN f USING (url)""",
}

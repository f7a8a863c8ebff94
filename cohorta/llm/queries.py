"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .common import work_path
from .decontaminate import contaminated
from .html_extract import main_text
from .minhash import near_duplicates
from .mixing import SEED, mix
from .pii import pseudonymize
from .quality import quality
from .toxicity import toxicity
from .urlfilter import judge
from .warc import read_warc, write_warc

#: Target shares of the mixture; other sources share the rest by their rows.
WEIGHTS = {"src0": 0.08, "src1": 0.10, "src2": 0.08, "src3": 0.06, "src4": 0.05}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of ``documents`` on 2-word shingles at 0.8."""
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS a
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(a) >= 2 THEN list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1]) ELSE a END) AS g FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)
), both_ways AS (
  SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a
), c AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.doc_id = w.doc_id
"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All copies of ``documents`` mixed to the target shares."""
    return mix(table(spark, sf_dir, "documents"), WEIGHTS).drop("mix_order")


OP2_SQL = f"""
WITH w(source, share) AS (VALUES {", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items())}),
n AS (SELECT d.source, share, count(*) AS n FROM documents d LEFT JOIN w USING (source) GROUP BY ALL),
t AS (SELECT sum(n) AS total, sum(n) FILTER (share IS NULL) AS rest, sum(share) AS given FROM n),
r AS (
  SELECT source, coalesce(share, (1 - {sum(WEIGHTS.values())!r}::DOUBLE) * n / rest) / (given + 1 - {sum(WEIGHTS.values())!r}::DOUBLE) * total / n AS rate FROM n, t
), u AS (
  SELECT d.*, rate, ('0x' || substr(md5('{SEED}:' || doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents d JOIN r USING (source)
), q AS (
  SELECT rate, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY rate ORDER BY k) AS cdf FROM (SELECT DISTINCT rate FROM r), range(0, 80) AS g(k)
), c AS (
  SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT min(k) FROM q WHERE q.rate = u.rate AND q.cdf >= u.u) AS reps FROM u
)
SELECT doc_id, text, lang, source, n_chars, reps::INT AS mix_repeats, unnest(range(1, reps + 1))::INT AS mix_copy FROM c WHERE reps > 0
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pseudonym_key(spark: SparkSession) -> str:
    """The key of ``spark.cohorta.pseudonymKey``; where that is unset, a known one, which is good for synthetic tables only."""
    return spark.conf.get("spark.cohorta.pseudonymKey", None) or "synthetic tables only"


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their personal data replaced by format-preserving pseudonyms."""
    return pseudonymize(table(spark, sf_dir, "documents"), pseudonym_key(spark))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under the model of the documents labelled good, and whether it stays."""
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality(table(spark, sf_dir, "documents"), trusted)


def training_labels(labels: DataFrame) -> DataFrame:
    """The rows that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity(docs, training_labels(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    path = work_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).where("record_type is not null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (SELECT sha256(b) AS d, min(page_id) AS first FROM p WHERE octet_length(b) >= 100 GROUP BY 1)
SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON f.d = sha256(p.b)
"""


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors found for every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page's url."""
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op3_decontaminate": op3_decontaminate,
    "op4_warc": op4_warc,
    "op5_main_text": op5_main_text,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_nearest": op7_nearest,
    "op8_url_filter": op8_url_filter,
    "op9_quality": op9_quality,
    "op10_toxicity": op10_toxicity,
}
ORACLE_SQL = {"op1_minhash_dedup": OP1_SQL, "op2_mix_sources": OP2_SQL, "op4_warc": OP4_SQL}

"""Registered queries over reports: pairs by position, bare names, and documents written and read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.functions import labels as lab
from evenkeel.operators import hooks, metrics, profile, reshape
from evenkeel.plans import fragments as sql
from evenkeel.plans import quality
from evenkeel.plans import tables as t
from evenkeel.plans.queries import ACCEPTANCE, RATIOS, _published
from evenkeel.plans.registry import query
from evenkeel.plans.round_trips import _equal_lengths
from evenkeel.sources.results import read_metrics, read_published
from evenkeel.sources.reviews import read_parallel_text
from evenkeel.workspace import new_path


@query(
    sql.with_tables(
        sql.RAW,
        sql.ORIGINALS,
        sql.spoken(3),
        """said AS (
  SELECT dataset_id, pass, src_id, paraphrase, row_number() OVER (PARTITION BY dataset_id, pass ORDER BY src_id) AS r
  FROM pairs WHERE (src_id + pass) % 4 <> 1)""",
        "ranked AS (SELECT dataset_id, text AS original, row_number() OVER (PARTITION BY dataset_id ORDER BY row_id) AS r FROM raw)",
        """scored AS (
  SELECT s.dataset_id, pass, src_id, paraphrase, original,
         CASE WHEN 2 * length(paraphrase) >= length(original) THEN 1.0::DOUBLE ELSE 0.0 END AS score
  FROM said s JOIN ranked USING (dataset_id, r))""",
        ACCEPTANCE,
        "accepted AS (SELECT * FROM scored WHERE score >= 0.85)",
        sql.bleu("accepted"),
    )
    + """SELECT dataset_id, count(*) AS n_passes, round(avg(n_accepted::DOUBLE / n_total), 4) AS acceptance_rate,
       round(avg(mean_score), 4) AS score_mean, round(stddev_pop(mean_score), 4) AS score_std,
       round(avg(bleu), 2) AS bleu_mean, round(stddev_pop(bleu), 2) AS bleu_std
FROM acceptance JOIN bleu USING (dataset_id, pass) GROUP BY dataset_id"""
)
def report_by_position(spark: SparkSession, sf: str) -> DataFrame:
    """Three quarters of each pass, held by position against the labelled documents of the same language."""
    log = t.generated(spark, sf).where((F.col("src_id") + F.col("pass")) % 4 != 1).drop("label")
    originals = t.examples(spark, sf, t.texts(spark, sf)).select("dataset_id", F.col("row_id").alias("src_id"), "text")
    return quality.report_by_position(log, originals, hooks.pair_scorer(_equal_lengths))


@query(
    sql.with_tables(
        sql.PREDICTIONS,
        sql.LABEL_SCORES,
        sql.REPORT,
        RATIOS,
        """names AS (SELECT DISTINCT lang AS author, lang || '-' || source AS name FROM documents JOIN labels USING (doc_id)),
config AS (
  SELECT * FROM names WHERE name <> 'de-src1' UNION ALL SELECT DISTINCT 'other', name FROM names WHERE name = 'en-src0'),
authors AS (SELECT name, count(DISTINCT author) AS n, max(author) AS author FROM config GROUP BY name),
asked AS (
  SELECT CASE WHEN strategy = 'baseline' THEN replace(dataset_id, '/', '-') ELSE split_part(dataset_id, '/', 1) || '/'
         || replace(dataset_id, '/', '-') END AS key, replace(dataset_id, '/', '-') AS name, strategy, macro_f1, dataset_id FROM report)""",
    )
    + """SELECT key, strategy, round(macro_f1, 6) AS macro_f1,
       CASE WHEN strategy <> 'baseline' THEN 'given' WHEN n = 1 THEN 'known' WHEN n > 1 THEN 'ambiguous' ELSE 'unknown' END AS resolution,
       CASE WHEN strategy <> 'baseline' OR n = 1 THEN round(imbalance_ratio, 6) END AS imbalance_ratio
FROM asked LEFT JOIN authors USING (name) LEFT JOIN ratios USING (dataset_id)"""
)
def bare_name_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Reports under bare names (one strategy) and full ones; one name has two authors and one has none."""
    labelled = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id")
    name = F.concat("lang", F.lit("-"), "source")
    names = labelled.select(F.col("lang").alias("author"), name.alias("name")).distinct()
    second = names.where("name = 'en-src0'").select(F.lit("other").alias("author"), "name")
    config = names.where("name <> 'de-src1'").unionByName(second)
    toxic = labelled.select(lab.dataset_key(F.col("lang"), name).alias("dataset_id"), F.col("toxic").alias("label"))
    bare = F.replace(F.col("dataset_id"), F.lit("/"), F.lit("-"))
    full = F.concat(F.substring_index("dataset_id", "/", 1), F.lit("/"), bare)
    report = metrics.fairness_report(t.predictions(spark, sf))
    asked = report.select(F.when(F.col("strategy") == "baseline", bare).otherwise(full).alias("key"), "strategy", "macro_f1")
    out = reshape.named_metrics_with_ratio(asked, config, profile.imbalance_summary(toxic))
    return out.select("key", "strategy", F.round("macro_f1", 6).alias("macro_f1"), "resolution", F.round("imbalance_ratio", 6).alias("imbalance_ratio"))


@query("SELECT md5(text) AS digest, CASE WHEN doc_id % 7 > 0 THEN 1 ELSE 0 END AS label, count(*) AS n FROM documents GROUP BY ALL")
def parallel_text_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Two series of text files, texts and scores, written in one order and aligned by line number."""
    texts, scores = new_path(spark, "texts"), new_path(spark, "scores")
    rows = t.texts(spark, sf).select("doc_id", F.md5("text").alias("digest"), F.when(F.col("doc_id") % 7 > 0, "1").otherwise("-1").alias("score"))
    ordered = rows.orderBy("doc_id")
    ordered.select(F.coalesce("digest", F.lit("")).alias("value")).write.text(texts)
    ordered.select(F.col("score").alias("value")).write.text(scores)
    read = read_parallel_text(spark, texts, scores)
    digest = F.when(F.col("text") != "", F.col("text"))
    return read.groupBy(digest.alias("digest"), "label").agg(F.count(F.lit(1)).alias("n"))


#: Documents to a written file.
PER_FILE = 64


@query(
    sql.with_tables(sql.PREDICTIONS, sql.LABEL_SCORES, sql.REPORT)
    + """SELECT dataset_id AS dataset, strategy AS method, round(macro_f1, 6) AS macro_f1,
       round(abs(tpr_class_0 - tpr_class_1), 6) AS tpr_gap FROM report
UNION ALL SELECT dataset_id, 'metrics', round(macro_f1, 6), round(abs(tpr_class_0 - tpr_class_1), 6)
FROM report WHERE strategy = 'baseline'"""
)
def published_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Nested documents as JSON arrays, and metrics as JSON objects keyed by dataset, each in several files and read again."""
    report = metrics.fairness_report(t.predictions(spark, sf))
    nested, keyed = new_path(spark, "published"), new_path(spark, "metrics")
    file = F.pmod(F.xxhash64("dataset"), F.lit(PER_FILE)).alias("file")
    arrays = _published(spark, sf).groupBy(file).agg(F.to_json(F.collect_list(F.struct("dataset", "methods"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(nested)
    values = F.struct("accuracy", "macro_f1", "tpr_class_0", "tpr_class_1", "tpr_gap").alias("m")
    entries = report.where("strategy = 'baseline'").select(F.col("dataset_id").alias("dataset"), values)
    objects = entries.groupBy(file).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("dataset", "m")))).alias("value"))
    objects.select("value").write.option("maxRecordsPerFile", 1).text(keyed)
    methods = reshape.flatten_methods(read_published(spark, nested)).select("dataset", "method", "macro_f1", "tpr_gap")
    read = read_metrics(spark, keyed).select(F.col("dataset_id").alias("dataset"), F.lit("metrics").alias("method"), "macro_f1", "tpr_gap")
    return methods.unionByName(read).withColumns({c: F.round(c, 6) for c in ("macro_f1", "tpr_gap")})

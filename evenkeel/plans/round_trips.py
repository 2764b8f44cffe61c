"""Registered queries that go through files, models and balanced rows, each over whole given tables.

Files are written to the session's working folder and read back, so the SQL of the tables they came from is the check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.constants import MAX_LENGTH, SCORE_THRESHOLD, SEED
from evenkeel.functions.labels import hash_order
from evenkeel.operators import balance, encoding, hooks, metrics, splits, upsert
from evenkeel.operators.ranking import file_positions
from evenkeel.plans import fragments as sql
from evenkeel.plans import paraphrase, prepare, queries
from evenkeel.plans import tables as t
from evenkeel.plans.ingest import ingest_reviews
from evenkeel.plans.registry import query
from evenkeel.sinks.tables import append_generated, materialise, write_report
from evenkeel.sinks.versions import read_version, upsert_version
from evenkeel.sources.results import read_generation_log, read_pass_log
from evenkeel.streaming.generation import generate_stream
from evenkeel.workspace import new_path, settle


@query(
    sql.with_tables(sql.REVIEWS)
    + """SELECT reviewText AS text, CASE WHEN overall > 2 THEN 1 ELSE 0 END AS label, count(*) AS n
FROM reviews WHERE overall <> 3 AND reviewText <> '' GROUP BY ALL"""
)
def reviews_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews to gzipped JSON lines and through the ingestion plan into labelled Parquet."""
    source, target = new_path(spark, "reviews"), new_path(spark, "labelled")
    t.reviews(spark, sf).write.option("compression", "gzip").json(source)
    return ingest_reviews(spark, source, target).groupBy("text", "label").agg(F.count(F.lit(1)).alias("n"))


@query(
    sql.with_tables(sql.RAW, sql.ORIGINALS, sql.spoken(3))
    + "SELECT dataset_id, src_id, pass, label, md5(paraphrase) AS digest FROM pairs"
)
def pass_log_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Generated texts as JSON lines whose ids name pass and source row, read and appended to the generation log."""
    made = settle(t.generated(spark, sf), "made")
    lines, log = new_path(spark, "pass-lines"), new_path(spark, "log")
    line_id = F.concat(F.lit("p"), "pass", F.lit("_orig_"), "src_id")
    made.select(line_id.alias("id"), "text", "label").write.json(lines)
    read = read_pass_log(spark, lines).join(made.select("dataset_id", "src_id", "pass"), ["src_id", "pass"])
    append_generated(read, log)
    logged = read_generation_log(spark, log)
    return logged.select("dataset_id", "src_id", "pass", "label", F.md5("text").alias("digest"))


@query(
    sql.with_tables(sql.RAW)
    + """SELECT 'baseline' AS strategy, dataset_id, CASE WHEN row_id % 2 = 0 THEN 'train' ELSE 'test' END AS split,
       count(*) AS n, sum(row_id)::BIGINT AS ids
FROM raw GROUP BY ALL"""
)
def materialise_twice(spark: SparkSession, sf: str) -> DataFrame:
    """Datasets written once: what is there already stays, however often and with whatever rows it is written again."""
    root = new_path(spark, "datasets")
    part = F.when(F.col("row_id") % 2 == 0, "train").otherwise("test")
    rows = t.examples(spark, sf).select(F.lit("baseline").alias("strategy"), "dataset_id", part.alias("split"), "row_id", "label")
    materialise(rows.where("split = 'train'"), root)
    materialise(rows.where("split = 'train' or row_id >= 0"), root)
    materialise(rows.withColumn("row_id", F.lit(-1).cast("long")), root)
    stored = spark.read.schema(rows.schema).parquet(root)
    return stored.groupBy("strategy", "dataset_id", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


@query(
    sql.with_tables(sql.PREDICTIONS, sql.LABEL_SCORES, sql.REPORT)
    + """SELECT dataset_id, strategy, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM report"""
)
def report_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "report")
    report = metrics.fairness_report(t.predictions(spark, sf))
    write_report(report, path)
    read = spark.read.schema(report.schema).json(path)
    return read.select("dataset_id", "strategy", F.round("accuracy", 6).alias("accuracy"), F.round("macro_f1", 6).alias("macro_f1"))


def _hashing_model():
    import hashlib

    return lambda prompts, passes: [f"{hashlib.md5(p.encode()).hexdigest()} {n}<turn|>" for p, n in zip(prompts, passes)]


@query(
    sql.with_tables(sql.RAW, sql.ORIGINALS)
    + "SELECT dataset_id, src_id, pass::INT AS pass, md5(text) || ' ' || pass AS text FROM originals, range(2) r(pass)"
)
def generate_batches(spark: SparkSession, sf: str) -> DataFrame:
    """A model behind the generator hook, in Arrow batches; it answers with a digest of its prompt."""
    samples = t.originals(spark, sf).withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1))))
    generate = hooks.batch_generator(_hashing_model, prompt=F.col("text"))
    return generate(samples).select("dataset_id", "src_id", "pass", "text")


def _word_lengths():
    return lambda texts: [[len(w) for w in text.split(" ")] for text in texts]


@query(
    f"""WITH ids AS (
  SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w))[1:{MAX_LENGTH}] AS ids FROM documents)
SELECT doc_id AS row_id, array_to_string(list_concat(ids, list_transform(range({MAX_LENGTH} - len(ids)), lambda x: 0)), ' ')
       AS input_ids, len(ids) AS n_used
FROM ids"""
)
def tokenize_hook(spark: SparkSession, sf: str) -> DataFrame:
    """A tokenizer behind the hook, in batches; its ids are cut and padded as those of the learned vocabulary."""
    ids = hooks.tokenizer_hook(_word_lengths)
    rows = t.texts(spark, sf).select(F.col("doc_id").alias("row_id"), ids(F.col("text")).alias("ids"))
    used = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, b: a + b)
    return encoding.fixed_length(rows).select("row_id", F.array_join("input_ids", " ").alias("input_ids"), used.alias("n_used"))


@query(
    sql.with_tables(sql.RAW, sql.ORIGINALS, sql.spoken(1))
    + "SELECT dataset_id, src_id, pass, label, md5(paraphrase) AS digest FROM pairs"
)
def stream_generation(spark: SparkSession, sf: str) -> DataFrame:
    """Generation as a stream of files, started again without its checkpoint: nothing is generated twice."""
    source, log = new_path(spark, "samples"), new_path(spark, "log")
    t.originals(spark, sf).select("dataset_id", "src_id", "text", "label").write.parquet(source)
    generate = hooks.expression_generator(t.varied_word_drop)
    for _ in range(2):
        generate_stream(spark, source, generate, log, new_path(spark, "checkpoint"), files_per_batch=8)
    logged = read_generation_log(spark, log)
    return logged.select("dataset_id", "src_id", "pass", "label", F.md5("text").alias("digest"))


def _equal_lengths(paraphrases: list[str], originals: list[str]) -> list[float]:
    return [1.0 if 2 * len(p) >= len(o) else 0.0 for p, o in zip(paraphrases, originals)]


@query(
    sql.with_tables(
        sql.RAW,
        queries.COUNTS,
        queries.NEED,
        """originals AS (
  SELECT dataset_id, row_id AS src_id, text, label FROM raw JOIN need USING (dataset_id)
  WHERE label = minority_label AND needed > 0)""",
        sql.spoken(15),
        sql.FEATURES,
        f"""chosen AS (
  SELECT dataset_id, src_id, pass, label, row_number() OVER (PARTITION BY dataset_id ORDER BY pass, src_id) AS r
  FROM features WHERE is_valid AND (CASE WHEN 2 * length(paraphrase) >= length(original) THEN 1.0 ELSE 0.0 END) >= {SCORE_THRESHOLD})""",
    )
    + """SELECT dataset_id, row_id, label, -1 AS pass FROM raw
UNION ALL SELECT c.dataset_id, src_id, label, pass FROM chosen c JOIN need USING (dataset_id) WHERE r <= needed"""
)
def paraphrase_balance_hook(spark: SparkSession, sf: str) -> DataFrame:
    """The balancing loop with a scorer behind the hook."""
    generate, score = hooks.expression_generator(t.varied_word_drop), hooks.pair_scorer(_equal_lengths)
    balanced = paraphrase.paraphrase_balance(t.examples(spark, sf, t.texts(spark, sf)), generate, score)
    return balanced.select("dataset_id", "row_id", "label", F.coalesce("pass", F.lit(-1)).alias("pass"))


DOUBLED = queries._duplicate_sql("raw")


@query(
    sql.with_tables(sql.RAW, DOUBLED)
    + f"""SELECT dataset_id, row_id, copy, label,
       CASE WHEN row_number() OVER (PARTITION BY dataset_id ORDER BY {sql.order_key("'42:val:' || row_id || ':' || copy")})
            <= greatest(1, count(*) OVER (PARTITION BY dataset_id) // 10) THEN 'val' ELSE 'train' END AS part
FROM doubled"""
)
def val_split_of_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """Validation rows of the duplicated examples: copies are rows of their own."""
    balanced = balance.duplicate_minority(t.examples(spark, sf))
    return splits.train_val_split(balanced, row=("row_id", "copy")).select("dataset_id", "row_id", "copy", "label", "part")


@query(
    sql.with_tables(
        sql.RAW,
        DOUBLED,
        "balanced AS (SELECT d.dataset_id, d.row_id, d.copy, text FROM doubled d JOIN raw USING (dataset_id, row_id))",
        f"token_rows AS (SELECT unnest({sql.tokens('text')}) AS token FROM balanced)",
        """vocabulary AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id
  FROM (SELECT token, count(*) AS n FROM token_rows GROUP BY token))""",
        f"""places AS (
  SELECT row_id, copy, unnest(w) AS token, generate_subscripts(w, 1) AS pos
  FROM (SELECT row_id, copy, ({sql.tokens('text')})[1:{MAX_LENGTH}] AS w FROM balanced))""",
    )
    + """SELECT row_id, copy, md5(string_agg(token_id, ' ' ORDER BY pos)) AS digest, count(*) AS n_used
FROM places JOIN vocabulary USING (token) GROUP BY ALL"""
)
def encode_duplicated(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the duplicated examples: one row for every copy."""
    balanced = balance.duplicate_minority(t.examples(spark, sf, t.texts(spark, sf)))
    encoded = encoding.encode_fixed(balanced)
    used = F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b)
    ids = F.array_join(F.slice("input_ids", F.lit(1), F.col("used")), " ")
    rows = encoded.withColumn("used", used).where("used > 0")
    return rows.select("row_id", "copy", F.md5(ids).alias("digest"), F.col("used").cast("long").alias("n_used"))


@query(
    sql.with_tables(sql.RAW)
    + f"""SELECT row_id, (row_number() OVER (ORDER BY {sql.order_key("'42:' || dataset_id || ':' || row_id")}, dataset_id, row_id)) - 1
       AS position FROM raw"""
)
def shuffled_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every row after the seeded shuffle, as the files of the shuffled rows have it."""
    from evenkeel.operators.ranking import shuffle_rows

    rows = shuffle_rows(t.examples(spark, sf).select("dataset_id", "row_id"), SEED, "dataset_id", "row_id")
    return file_positions(settle(rows, "shuffled"), []).select("row_id", "position")


METRIC_LOG = "dataset_id string, macro_f1 double"

PREPARED = f"""parts AS ({queries._split_sql('raw')}),
train AS (SELECT * FROM parts WHERE split = 'train'),
{queries._duplicate_sql('train')},
originals AS (
  SELECT dataset_id, row_id AS src_id, text, label FROM train JOIN need USING (dataset_id)
  WHERE label = minority_label AND needed > 0),
{sql.spoken(15)},
{sql.FEATURES},
chosen AS (
  SELECT dataset_id, src_id, label, row_number() OVER (PARTITION BY dataset_id ORDER BY pass, src_id) AS r
  FROM features WHERE is_valid AND (CASE WHEN 2 * length(paraphrase) >= length(original) THEN 1.0 ELSE 0.0 END) >= {SCORE_THRESHOLD}),
kept AS (
  SELECT 'baseline' AS strategy, dataset_id, label, row_id FROM train
  UNION ALL SELECT 'simple_oversampling', dataset_id, label, row_id FROM doubled
  UNION ALL SELECT 'undersampling', dataset_id, label, row_id FROM (
    SELECT train.*, minority_count, row_number() OVER (PARTITION BY dataset_id, label ORDER BY {queries.RANDOM_KEY}, row_id) AS r
    FROM train JOIN need USING (dataset_id)) WHERE r <= minority_count
  UNION ALL SELECT 'llm_paraphrasing', dataset_id, label, row_id FROM train
  UNION ALL SELECT 'llm_paraphrasing', c.dataset_id, label, src_id FROM chosen c JOIN need USING (dataset_id) WHERE r <= needed),
before AS (SELECT dataset_id, label, count(*) AS n_before FROM train GROUP BY ALL),
after AS (SELECT strategy, dataset_id, label, count(*) AS n_after, sum(row_id)::BIGINT AS ids FROM kept GROUP BY ALL)"""


@query(
    sql.with_tables(sql.RAW, PREPARED)
    + "SELECT strategy, dataset_id, label, n_before, n_after, n_after AS n_stored, ids FROM after JOIN before USING (dataset_id, label)"
)
def prepare_strategies(spark: SparkSession, sf: str) -> DataFrame:
    """All strategies end to end, each run twice: the second time everything is there already, so its generator is none."""
    root, counts = new_path(spark, "prepared"), []
    examples = settle(t.examples(spark, sf, t.texts(spark, sf)), "examples")
    for strategy in ("baseline", "simple_oversampling", "undersampling", "llm_paraphrasing"):
        generate, score = hooks.expression_generator(t.varied_word_drop), hooks.pair_scorer(_equal_lengths)
        prepare.prepare(examples, strategy, root, generate, score)
        counts.append(prepare.prepare(examples, strategy, root))
    rows = spark.read.parquet(root).where("split = 'train'").groupBy("strategy", "dataset_id", F.col("label").cast("int").alias("label"))
    rows = rows.agg(F.count(F.lit(1)).alias("n_stored"), F.sum("row_id").alias("ids"))
    return reduce(DataFrame.unionByName, counts).join(rows, ["strategy", "dataset_id", "label"])


@query(
    sql.with_tables(sql.RAW)
    + f"""SELECT dataset_id, row_id,
       row_number() OVER (PARTITION BY dataset_id ORDER BY {sql.order_key("'42:' || dataset_id || ':' || row_id")}, row_id) - 1 AS position
FROM raw"""
)
def stored_order(spark: SparkSession, sf: str) -> DataFrame:
    """Examples stored in a seeded order; the position of a row is read off its dataset's files."""
    root = new_path(spark, "ordered")
    place = hash_order(SEED, F.col("dataset_id"), F.col("row_id"))
    materialise(t.examples(spark, sf).select("dataset_id", "row_id", "label", place.alias("place")), root, ["dataset_id"], order="place")
    read = spark.read.schema("row_id long, label int, place long, dataset_id string").parquet(root)
    return file_positions(read, ["dataset_id"]).select("dataset_id", "row_id", "position")


@query(
    """WITH latest AS (
  SELECT o_custkey, o_orderkey % 3 AS turn, arg_max(struct_pack(s := o_orderstatus, p := o_totalprice),
         struct_pack(d := o_orderdate, k := o_orderkey)) AS last
  FROM orders GROUP BY ALL)
SELECT 'cust/' || o_custkey AS dataset_id, last.p AS macro_f1 FROM latest WHERE last.s <> 'F'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY turn DESC) = 1"""
)
def upsert_versions(spark: SparkSession, sf: str) -> DataFrame:
    """The metric log over three writes, each a version of its own; read from the version that the manifest names."""
    root = new_path(spark, "metric-log")
    value = F.struct("o_orderstatus", "o_totalprice")
    for turn in range(3):
        orders = t.table(spark, sf, "orders").where(F.col("o_orderkey") % 3 == turn).groupBy("o_custkey")
        latest = orders.agg(F.max_by(value, F.struct("o_orderdate", "o_orderkey")).alias("v"))
        evaluated = latest.select(
            F.concat(F.lit("cust/"), "o_custkey").alias("dataset_id"),
            F.col("v.o_totalprice").alias("macro_f1"),
            (F.col("v.o_orderstatus") != "F").alias("success"),
        )
        upsert_version(evaluated, root, METRIC_LOG, upsert.upsert_metrics)
    return read_version(spark, root, METRIC_LOG)

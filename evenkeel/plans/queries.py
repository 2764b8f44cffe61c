"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.constants import (
    MAX_LENGTH,
    PROMPT_PREFIX,
    PROMPT_SUFFIX,
    SCORE_THRESHOLD,
    SEED,
    SPACE_CLASS,
    STOP_PATTERN,
)
from evenkeel.functions import labels as lab
from evenkeel.functions import text as txt
from evenkeel.operators import (
    balance,
    bleu,
    encoding,
    hooks,
    joining,
    matching,
    metrics,
    near_miss,
    profile,
    quality,
    ranking,
    reshape,
    splits,
    upsert,
)
from evenkeel.plans import comparison, paraphrase, training
from evenkeel.plans import fragments as sql
from evenkeel.plans import tables as t
from evenkeel.plans.registry import query
from evenkeel.workspace import settle

PAIR = ["dataset_id", "pass", "src_id"]


# ---- Profiles -------------------------------------------------------------------------------------------


@query(
    sql.with_tables(sql.EVERYTHING)
    + "SELECT dataset_id, label, count(*) AS n FROM everything WHERE label >= 0 GROUP BY ALL"
)
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = t.all_examples(spark, sf)
    return profile.class_distribution(rows.where(lab.is_labelled(F.col("label"))))


COUNTS = "counts AS (SELECT dataset_id, label, count(*) AS n, min(row_id) AS first FROM raw GROUP BY ALL)"


@query(
    sql.with_tables(sql.RAW, COUNTS)
    + """SELECT dataset_id, sum(n)::BIGINT AS total, min(n) AS minority, max(n) AS majority,
       round(max(n)::DOUBLE / min(n), 6) AS imbalance_ratio
FROM counts GROUP BY dataset_id"""
)
def imbalance_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = profile.imbalance_summary(t.all_examples(spark, sf))
    return out.withColumn("imbalance_ratio", F.round("imbalance_ratio", 6))


@query(
    sql.with_tables(sql.EVERYTHING)
    + """SELECT dataset_id, label, n, round(100.0::DOUBLE * n / sum(n) OVER (PARTITION BY dataset_id), 6) AS percent
FROM (SELECT dataset_id, label, count(*) AS n FROM everything GROUP BY ALL)"""
)
def class_shares(spark: SparkSession, sf: str) -> DataFrame:
    return profile.class_shares(t.all_examples(spark, sf)).withColumn("percent", F.round("percent", 6))


NEED = """need AS (
  SELECT dataset_id, arg_min(label, struct_pack(n := n, first := first)) AS minority_label,
         min(n) AS minority_count, max(n) AS majority_count, max(n) - min(n) AS needed, count(*) AS n_classes
  FROM counts GROUP BY dataset_id)"""


@query(sql.with_tables(sql.RAW, COUNTS, NEED) + "SELECT * FROM need")
def balance_need(spark: SparkSession, sf: str) -> DataFrame:
    return profile.balance_need(t.examples(spark, sf))


# ---- Labels and keys ------------------------------------------------------------------------------------


@query(
    sql.with_tables(sql.REVIEWS)
    + """SELECT overall, CASE WHEN overall <= 2 THEN 0 ELSE 1 END AS label, count(*) AS n
FROM reviews WHERE overall <> 3 AND length(reviewText) > 0 GROUP BY ALL"""
)
def binarise_ratings(spark: SparkSession, sf: str) -> DataFrame:
    kept = t.reviews(spark, sf).where(lab.is_opinion(F.col("overall"), F.col("reviewText")))
    return kept.groupBy("overall", lab.binarise_rating(F.col("overall")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    """SELECT doc_id AS row_id, quality - toxic AS score,
       CASE WHEN quality - toxic = -1 THEN 0 ELSE 1 END AS label FROM labels"""
)
def binarise_scores(spark: SparkSession, sf: str) -> DataFrame:
    score = F.col("quality") - F.col("toxic")
    return t.table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"), score.alias("score"), lab.binarise_score(score).alias("label")
    )


@query(
    """SELECT c_custkey, c_mktsegment || '/' || c_name AS key, c_mktsegment AS author, c_name AS name,
       'p' || c_nationkey || '_orig_' || c_custkey AS pid, c_nationkey AS pass_no, c_custkey AS src_id
FROM customer"""
)
def dataset_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = lab.dataset_key(F.col("c_mktsegment"), F.col("c_name"))
    pid = lab.paraphrase_id(F.col("c_nationkey"), F.col("c_custkey"))
    built = t.table(spark, sf, "customer").select("c_custkey", key.alias("key"), pid.alias("pid"))
    return built.select(
        "*",
        lab.key_author(F.col("key")).alias("author"),
        lab.key_name(F.col("key")).alias("name"),
        lab.paraphrase_pass(F.col("pid")).alias("pass_no"),
        lab.paraphrase_source(F.col("pid")).alias("src_id"),
    )


@query(
    """SELECT o_orderkey, c_name AS name, c_mktsegment AS author,
       CASE WHEN o_orderstatus = 'F' THEN c_mktsegment || '/' || c_name ELSE c_name END AS key
FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def resolve_author(spark: SparkSession, sf: str) -> DataFrame:
    customers = t.table(spark, sf, "customer")
    full = lab.dataset_key(F.col("c_mktsegment"), F.col("c_name"))
    key = F.when(F.col("o_orderstatus") == "F", full).otherwise(F.col("c_name"))
    keys = (
        t.table(spark, sf, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", key.alias("key"))
    )
    config = customers.select(F.col("c_mktsegment").alias("author"), F.col("c_name").alias("name"))
    return reshape.resolve_author(keys, config)


@query(
    sql.with_tables(sql.RAW)
    + "SELECT dataset_id, row_id, label FROM raw WHERE dataset_id IN ('lang/en', 'lang/fr')"
)
def select_datasets(spark: SparkSession, sf: str) -> DataFrame:
    chosen = reshape.select_datasets(t.examples(spark, sf), ["lang/en", "lang/fr"])
    return chosen.select("dataset_id", "row_id", "label")


@query(
    sql.with_tables(
        """best AS (
  SELECT vec_id, list_max(embedding) AS top, list_position(embedding, list_max(embedding)) - 1 AS label
  FROM embeddings)"""
    )
    + "SELECT vec_id, label::INT AS label FROM best"
)
def argmax_label(spark: SparkSession, sf: str) -> DataFrame:
    return t.table(spark, sf, "embeddings").select(
        "vec_id", lab.argmax_label(F.col("embedding")).alias("label")
    )


# ---- Splits and positions -------------------------------------------------------------------------------


def _split_sql(source: str) -> str:
    key = sql.order_key("'42:' || row_id")
    return f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY dataset_id ORDER BY {key}, row_id)
         <= ceil(count(*) OVER (PARTITION BY dataset_id) / 5.0) THEN 'test' ELSE 'train' END AS split
  FROM {source}"""


@query(
    sql.with_tables(sql.RAW, f"parts AS ({_split_sql('raw')})")
    + "SELECT dataset_id, row_id, label, split FROM parts"
)
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.train_test_split(t.examples(spark, sf)).select("dataset_id", "row_id", "label", "split")


VAL_KEY = sql.order_key("'42:val:' || row_id")


@query(
    sql.with_tables(sql.RAW, f"parts AS ({_split_sql('raw')})", "train AS (SELECT * FROM parts WHERE split = 'train')")
    + f"""SELECT dataset_id, row_id, label,
       CASE WHEN row_number() OVER (PARTITION BY dataset_id ORDER BY {VAL_KEY}, row_id)
            <= greatest(1, count(*) OVER (PARTITION BY dataset_id) // 10) THEN 'val' ELSE 'train' END AS part
FROM train"""
)
def train_val_split(spark: SparkSession, sf: str) -> DataFrame:
    train = splits.train_test_split(t.examples(spark, sf)).where(F.col("split") == "train")
    return splits.train_val_split(train).select("dataset_id", "row_id", "label", "part")


SPLIT_RAW = """split_raw AS (
  SELECT 'lang/' || lang AS dataset_id, doc_id AS row_id, quality AS label,
         CASE lang WHEN 'en' THEN CASE WHEN source LIKE 'src1%' THEN 'test' WHEN source = 'src7' THEN 'extra'
                                       ELSE 'train' END
                   WHEN 'de' THEN 'train' END AS part
  FROM documents JOIN labels USING (doc_id))"""


@query(
    sql.with_tables(
        SPLIT_RAW,
        """shapes AS (
  SELECT dataset_id, bool_or(coalesce(part, 'train') = 'train') AND bool_or(coalesce(part, '') = 'test') AS native
  FROM split_raw GROUP BY ALL)""",
        "flat AS (SELECT s.* FROM split_raw s JOIN shapes USING (dataset_id) WHERE NOT native)",
        f"parts AS ({_split_sql('flat')})",
    )
    + """SELECT dataset_id, row_id, label, part AS split FROM split_raw JOIN shapes USING (dataset_id)
WHERE native AND part IN ('train', 'test')
UNION ALL SELECT dataset_id, row_id, label, split FROM parts"""
)
def split_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return splits.resolve_splits(t.split_examples(spark, sf)).select("dataset_id", "row_id", "label", "split")


@query(
    sql.with_tables(
        sql.RAW,
        "placed AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY row_id) - 1 AS position FROM raw)",
    )
    + "SELECT dataset_id, row_id, position FROM placed WHERE label = 0"
)
def row_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Position inside the dataset, kept through the class filter."""
    rows = t.examples(spark, sf).select("dataset_id", "row_id", "label")
    placed = ranking.row_positions(rows, ["dataset_id"], ["row_id"])
    return placed.where(F.col("label") == 0).select("dataset_id", "row_id", "position")


@query(
    """SELECT user_id, event_id FROM (
  SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r,
         count(*) OVER (PARTITION BY user_id) AS n
  FROM events) WHERE r <= n // 2"""
)
def first_n(spark: SparkSession, sf: str) -> DataFrame:
    """The first half of every user's events."""
    rows = t.table(spark, sf, "events").select("user_id", "event_id")
    order = F.col("event_id")
    return ranking.first_n(rows, ["user_id"], order, order, F.floor(F.col("n") / 2))


@query(
    sql.with_tables(sql.RAW)
    + f"""SELECT row_id, row_number() OVER (ORDER BY {sql.order_key("'42:' || dataset_id || ':' || row_id")}, row_id) - 1 AS position FROM raw"""
)
def seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every row in the seeded order over all datasets."""
    key = lab.hash_order(SEED, F.col("dataset_id"), F.col("row_id"))
    rows = t.examples(spark, sf).select(F.lit(0).alias("everything"), "row_id", key.alias("key"))
    placed = ranking.row_positions(rows, ["everything"], ["key", "row_id"])
    return placed.select("row_id", "position")


# ---- Balancing ------------------------------------------------------------------------------------------


def _duplicate_sql(source: str) -> str:
    return f"""counts AS (SELECT dataset_id, label, count(*) AS n, min(row_id) AS first FROM {source} GROUP BY ALL),
{NEED},
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.dataset_id, label ORDER BY row_id) AS r, minority_label,
         minority_count, needed
  FROM {source} s JOIN need USING (dataset_id)),
doubled AS (
  SELECT dataset_id, row_id, label,
         unnest(range(CASE WHEN label = minority_label AND needed > 0
           THEN 1 + needed // minority_count + (CASE WHEN r <= needed % minority_count THEN 1 ELSE 0 END)
           ELSE 1 END)) AS copy
  FROM ranked)"""


@query(sql.with_tables(sql.RAW, _duplicate_sql("raw")) + "SELECT dataset_id, row_id, label, copy FROM doubled")
def duplicate_minority(spark: SparkSession, sf: str) -> DataFrame:
    return balance.duplicate_minority(t.examples(spark, sf)).select("dataset_id", "row_id", "label", "copy")


@query(
    sql.with_tables(sql.EVENTS, _duplicate_sql("stream")) + "SELECT dataset_id, row_id, label, copy FROM doubled"
)
def duplicate_minority_events(spark: SparkSession, sf: str) -> DataFrame:
    """The same on one large dataset with a ratio of 39."""
    return balance.duplicate_minority(t.event_examples(spark, sf)).select("dataset_id", "row_id", "label", "copy")


@query(
    sql.with_tables(sql.RAW, _duplicate_sql("raw"))
    + """SELECT dataset_id, label, max(n_before) AS n_before, max(n_after) AS n_after FROM (
  SELECT dataset_id, label, n AS n_before, 0 AS n_after FROM counts
  UNION ALL SELECT dataset_id, label, 0, count(*) FROM doubled GROUP BY ALL) GROUP BY ALL"""
)
def before_after_counts(spark: SparkSession, sf: str) -> DataFrame:
    before = t.examples(spark, sf)
    return profile.before_after_counts(before, balance.duplicate_minority(before))


RANDOM_KEY = sql.order_key("'42:' || row_id")


@query(
    sql.with_tables(sql.RAW, COUNTS, NEED)
    + f"""SELECT dataset_id, row_id, label FROM (
  SELECT raw.*, row_number() OVER (PARTITION BY dataset_id, label ORDER BY {RANDOM_KEY}, row_id) AS r, minority_count
  FROM raw JOIN need USING (dataset_id)) WHERE r <= minority_count"""
)
def undersample_random(spark: SparkSession, sf: str) -> DataFrame:
    return balance.undersample_random(t.examples(spark, sf)).select("dataset_id", "row_id", "label")


def _near_miss_sql(direction: str) -> str:
    return (
        sql.with_tables(
            "points AS (SELECT vec_id, embedding::DOUBLE[] AS v, label <> 0 AS big FROM embeddings)",
            """gaps AS (
  SELECT a.vec_id, list_distance(a.v, b.v) AS d FROM points a JOIN points b ON a.big AND NOT b.big)""",
            f"""near AS (
  SELECT vec_id, d, row_number() OVER (PARTITION BY vec_id ORDER BY d {direction}) AS r FROM gaps)""",
            """far AS (
  SELECT vec_id, round(avg(d) * 1000000)::BIGINT AS far FROM near WHERE r <= 3 GROUP BY vec_id)""",
            """kept AS (
  SELECT vec_id, row_number() OVER (ORDER BY far, vec_id) AS r FROM far)""",
        )
        + """SELECT vec_id AS row_id, 1 AS label FROM kept WHERE r <= (SELECT count(*) FROM points WHERE NOT big)
UNION ALL SELECT vec_id, 0 FROM points WHERE NOT big"""
    )


@query(_near_miss_sql("ASC"))
def near_miss_1(spark: SparkSession, sf: str) -> DataFrame:
    return near_miss.near_miss(t.vector_examples(spark, sf)).select("row_id", "label")


@query(_near_miss_sql("DESC"))
def near_miss_2(spark: SparkSession, sf: str) -> DataFrame:
    return near_miss.near_miss(t.vector_examples(spark, sf), farthest=True).select("row_id", "label")


# ---- Text -----------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, array_to_string({sql.tokens('text')}, ' ') AS tokens, len({sql.tokens('text')}) AS n FROM documents")
def ws_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = t.texts(spark, sf).select("doc_id", txt.ws_tokens(F.col("text")).alias("tokens"))
    return tokens.select("doc_id", F.array_join("tokens", " ").alias("tokens"), F.size("tokens").cast("long").alias("n"))


@query(
    f"SELECT doc_id, array_to_string(list_sort({sql.content(sql.tokens('text'))}), ' ') AS words FROM documents"
)
def content_words(spark: SparkSession, sf: str) -> DataFrame:
    words = txt.content_words(F.col("text"))
    return t.texts(spark, sf).select("doc_id", F.array_join(F.sort_array(words), " ").alias("words"))


@query(
    sql.with_tables(sql.RAW, sql.ORIGINALS, sql.spoken(3), sql.FEATURES)
    + """SELECT dataset_id, src_id, pass, round(length_ratio, 6) AS length_ratio,
       round(content_overlap, 6) AS content_overlap, is_valid FROM features"""
)
def valid_paraphrase(spark: SparkSession, sf: str) -> DataFrame:
    return quality.paraphrase_features(t.pairs(spark, sf)).select(
        "dataset_id",
        "src_id",
        "pass",
        F.round("length_ratio", 6).alias("length_ratio"),
        F.round("content_overlap", 6).alias("content_overlap"),
        "is_valid",
    )


def _prompt_sql() -> str:
    words, budget = sql.words("text"), txt.prompt_budget()
    prefix = sql.quoted(PROMPT_PREFIX).replace("\n", "' || chr(10) || '")
    suffix = sql.quoted(PROMPT_SUFFIX).replace("\n", "' || chr(10) || '")
    return f"""WITH split_texts AS (SELECT doc_id, text, {words} AS w FROM documents)
SELECT doc_id, len(w) > {budget} AS was_cut,
       {prefix} || CASE WHEN len(w) > {budget} THEN array_to_string(w[1:{budget}], ' ') ELSE text END || {suffix} AS prompt
FROM split_texts"""


@query(_prompt_sql())
def build_prompt(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return t.texts(spark, sf).select(
        "doc_id",
        (F.size(txt.split_words(text)) > txt.prompt_budget()).alias("was_cut"),
        txt.build_prompt(text).alias("prompt"),
    )


TRIM = sql.quoted(rf"^{SPACE_CLASS}+|{SPACE_CLASS}+$")


@query(
    f"""SELECT conv_id, turn, regexp_replace(regexp_split_to_array('  ' || replace(text, chr(10), chr(10) || chr(10)) || '<turn|>' || role,
       {sql.quoted(STOP_PATTERN)})[1], {TRIM}, '', 'g') AS cleaned FROM conversations"""
)
def clean_generation(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with their lines set apart by blank lines and an end marker, as raw model output."""
    blank = F.replace(F.col("text"), F.lit("\n"), F.lit("\n\n"))
    raw = F.concat(F.lit("  "), blank, F.lit("<turn|>"), F.col("role"))
    return t.table(spark, sf, "conversations").select("conv_id", "turn", txt.clean_generation(raw).alias("cleaned"))


ENCODED = f"""token_rows AS (SELECT doc_id, unnest({sql.tokens('text')}) AS token FROM documents),
vocabulary AS (
  SELECT token, row_number() OVER (ORDER BY n DESC, token) + 1 AS token_id
  FROM (SELECT token, count(*) AS n FROM token_rows GROUP BY token)),
places AS (
  SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, ({sql.tokens('text')})[1:{MAX_LENGTH}] AS w FROM documents)),
ids AS (
  SELECT doc_id, list(token_id ORDER BY pos) AS ids
  FROM places JOIN vocabulary USING (token) GROUP BY doc_id),
encoded AS (
  SELECT d.doc_id, coalesce(ids, []) AS ids, {MAX_LENGTH} - len(coalesce(ids, [])) AS free
  FROM documents d LEFT JOIN ids USING (doc_id))"""


def _fill_sql(inner: str, outer: str) -> str:
    return f"array_to_string(list_concat({inner}, list_transform(range(free), lambda x: {outer})), ' ')"


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    key = lab.dataset_key(F.lit("lang"), F.col("lang"))
    rows = t.texts(spark, sf).select(key.alias("dataset_id"), F.col("doc_id").alias("row_id"), "text")
    return encoding.encode_fixed(rows)


@query(
    sql.with_tables(ENCODED)
    + f"""SELECT doc_id AS row_id, {_fill_sql('ids', '0')} AS input_ids, len(ids) AS n_used FROM encoded"""
)
def encode_fixed(spark: SparkSession, sf: str) -> DataFrame:
    used = F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, b: a + b)
    return _encoded(spark, sf).select("row_id", F.array_join("input_ids", " ").alias("input_ids"), used.alias("n_used"))


@query(
    sql.with_tables(ENCODED)
    + f"""SELECT {_fill_sql('ids', '0')} AS input_ids,
       {_fill_sql('list_transform(ids, lambda x: 1)', '0')} AS attention_mask, quality AS labels
FROM encoded JOIN labels USING (doc_id)"""
)
def feature_view(spark: SparkSession, sf: str) -> DataFrame:
    labels = t.table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))
    view = encoding.feature_view(_encoded(spark, sf).join(labels, "row_id"))
    return view.select(
        F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("attention_mask", " ").alias("attention_mask"),
        "labels",
    )


# ---- Metrics --------------------------------------------------------------------------------------------

ROUNDED = ["accuracy", "macro_f1", "tpr_class_0", "tpr_class_1", "tpr_gap"]


@query(
    sql.with_tables(sql.PREDICTIONS, sql.LABEL_SCORES, sql.REPORT)
    + """SELECT dataset_id, strategy, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(tpr_class_0, 6) AS tpr_class_0, round(tpr_class_1, 6) AS tpr_class_1,
       round(abs(tpr_class_0 - tpr_class_1), 6) AS tpr_gap FROM report"""
)
def fairness_report(spark: SparkSession, sf: str) -> DataFrame:
    report = metrics.fairness_report(t.predictions(spark, sf))
    return report.select("dataset_id", "strategy", *[F.round(c, 6).alias(c) for c in ROUNDED])


@query(
    sql.with_tables(sql.PREDICTIONS, sql.LABEL_SCORES, sql.REPORT)
    + "SELECT dataset_id, strategy, round(macro_f1, 6) AS macro_f1 FROM report"
)
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.macro_f1(t.predictions(spark, sf)).withColumn("macro_f1", F.round("macro_f1", 6))


@query(
    sql.with_tables(sql.PREDICTIONS)
    + """SELECT dataset_id, strategy,
       count(*) FILTER (y_true = 0 AND y_pred = 0) AS c00, count(*) FILTER (y_true = 0 AND y_pred = 1) AS c01,
       count(*) FILTER (y_true = 1 AND y_pred = 0) AS c10, count(*) FILTER (y_true = 1 AND y_pred = 1) AS c11
FROM predictions GROUP BY ALL"""
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion_matrix(t.predictions(spark, sf))


@query(
    sql.with_tables(
        sql.PREDICTIONS,
        sql.LABEL_SCORES,
        """rated AS (
  SELECT *, CASE WHEN predicted > 0 THEN tp::DOUBLE / predicted ELSE 0 END AS precision,
         tp::DOUBLE / support AS recall,
         row_number() OVER (PARTITION BY dataset_id, strategy ORDER BY support DESC, label DESC) AS most,
         row_number() OVER (PARTITION BY dataset_id, strategy ORDER BY support, label) AS least
  FROM scores WHERE support > 0)""",
    )
    + """SELECT a.dataset_id, a.strategy, a.label AS majority_label, round(a.precision, 6) AS precision_majority,
       round(a.recall, 6) AS recall_majority, b.label AS minority_label, round(b.precision, 6) AS precision_minority,
       round(b.recall, 6) AS recall_minority
FROM rated a JOIN rated b USING (dataset_id, strategy) WHERE a.most = 1 AND b.least = 1"""
)
def class_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    out = metrics.class_precision_recall(t.predictions(spark, sf))
    rounded = [c for c in out.columns if c.startswith(("precision", "recall"))]
    return out.withColumns({c: F.round(c, 6) for c in rounded})


# ---- Generated text -------------------------------------------------------------------------------------


@query(
    sql.with_tables(sql.RAW, sql.ORIGINALS, sql.spoken(3))
    + "SELECT dataset_id, src_id, pass, paraphrase, original FROM pairs"
)
def paraphrase_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Log entries joined to their originals by id."""
    joined = joining.pair_by_id(t.generated(spark, sf), t.originals(spark, sf))
    return joined.select("dataset_id", "src_id", "pass", "paraphrase", "original")


@query(
    sql.with_tables(
        """asked AS (SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS position FROM documents)""",
        """marked AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS position
           FROM documents JOIN labels USING (doc_id))""",
    )
    + """SELECT lang AS dataset_id, position, length(text) AS original_chars, n_chars
FROM asked JOIN marked USING (lang, position)"""
)
def positional_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All documents against the labelled ones, paired by position per language."""
    documents = t.table(spark, sf, "documents").select(
        F.col("lang").alias("dataset_id"), F.col("doc_id").alias("row_id"), "text", "n_chars"
    )
    labelled = t.table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"))
    marked = documents.join(labelled, "row_id", "left_semi")
    paired = quality.pair_by_position(marked, documents)
    chars = F.char_length("original").cast("long").alias("original_chars")
    return paired.select("dataset_id", "position", chars, "n_chars")


@query(
    sql.with_tables(sql.RAW, sql.ORIGINALS, sql.spoken(3), sql.bleu("pairs"))
    + """SELECT dataset_id, pass, round(bleu, 6) AS bleu, hypothesis_length::BIGINT AS hypothesis_length,
       reference_length::BIGINT AS reference_length FROM bleu"""
)
def corpus_bleu(spark: SparkSession, sf: str) -> DataFrame:
    out = bleu.corpus_bleu(t.pairs(spark, sf), ["dataset_id", "pass"], PAIR)
    return out.withColumn("bleu", F.round("bleu", 6))


@query(
    sql.with_tables(sql.RAW, sql.ORIGINALS, sql.spoken(3), sql.scored("pairs"))
    + "SELECT dataset_id, src_id, pass, round(score, 6) AS score FROM scored"
)
def greedy_match_f1(spark: SparkSession, sf: str) -> DataFrame:
    scored = matching.greedy_match_f1(t.pairs(spark, sf), t.token_vectors(spark, sf), PAIR, keep=PAIR)
    return scored.select("dataset_id", "src_id", "pass", F.round("score", 6).alias("score"))


ACCEPTANCE = f"""acceptance AS (
  SELECT dataset_id, pass, count(*) AS n_total, count(*) FILTER (score >= {SCORE_THRESHOLD}) AS n_accepted,
         avg(score) FILTER (score >= {SCORE_THRESHOLD}) AS mean_score
  FROM scored GROUP BY ALL HAVING n_total >= 2 AND n_accepted >= 2)"""


@query(
    sql.with_tables(sql.RAW, sql.ORIGINALS, sql.spoken(3), sql.scored("pairs"), ACCEPTANCE)
    + """SELECT dataset_id, pass, n_total, n_accepted, round(mean_score, 6) AS mean_score,
       round(n_accepted::DOUBLE / n_total, 6) AS acceptance_rate FROM acceptance"""
)
def acceptance_per_pass(spark: SparkSession, sf: str) -> DataFrame:
    scored = matching.greedy_match_f1(t.pairs(spark, sf), t.token_vectors(spark, sf), PAIR, keep=["dataset_id", "pass"])
    out = quality.acceptance_per_pass(scored)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "acceptance_rate")})


@query(
    sql.with_tables(
        sql.RAW,
        sql.ORIGINALS,
        sql.spoken(3),
        sql.scored("pairs"),
        ACCEPTANCE,
        f"accepted AS (SELECT * FROM scored WHERE score >= {SCORE_THRESHOLD})",
        sql.bleu("accepted"),
    )
    + """SELECT dataset_id, count(*) AS n_passes, round(avg(n_accepted::DOUBLE / n_total), 4) AS acceptance_rate,
       round(avg(mean_score), 4) AS score_mean, round(stddev_pop(mean_score), 4) AS score_std,
       round(avg(bleu), 2) AS bleu_mean, round(stddev_pop(bleu), 2) AS bleu_std
FROM acceptance JOIN bleu USING (dataset_id, pass) GROUP BY dataset_id"""
)
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    scored = matching.greedy_match_f1(t.pairs(spark, sf), t.token_vectors(spark, sf), PAIR)
    return quality.quality_report(quality.pass_quality(scored, PAIR))


@query(
    sql.with_tables(sql.RAW, sql.ORIGINALS, sql.spoken(3))
    + """SELECT dataset_id, src_id, pass FROM pairs
WHERE pass < 2 AND (dataset_id, src_id) NOT IN (SELECT ('lang/' || lang, doc_id) FROM documents WHERE source < 'src15')
   OR pass = 2"""
)
def pending_generation(spark: SparkSession, sf: str) -> DataFrame:
    """Passes 0 to 2 against a log that holds two passes of the sources before src15."""
    samples = t.pairs(spark, sf).select("dataset_id", "src_id", "pass")
    done = t.table(spark, sf, "documents").where(F.col("source") < "src15")
    log = done.select(
        lab.dataset_key(F.lit("lang"), F.col("lang")).alias("dataset_id"),
        F.col("doc_id").alias("src_id"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("pass"),
    )
    return joining.pending(samples, log, ["dataset_id", "src_id", "pass"])


@query(
    sql.with_tables(
        sql.RAW,
        COUNTS,
        NEED,
        """originals AS (
  SELECT dataset_id, row_id AS src_id, text, label FROM raw JOIN need USING (dataset_id)
  WHERE label = minority_label AND needed > 0)""",
        sql.spoken(15),
        sql.FEATURES,
        "valid AS (SELECT * FROM features WHERE is_valid)",
        sql.scored("valid"),
        f"""chosen AS (
  SELECT dataset_id, src_id, pass, label, paraphrase,
         row_number() OVER (PARTITION BY dataset_id ORDER BY pass, src_id) AS r
  FROM scored WHERE score >= {SCORE_THRESHOLD})""",
    )
    + """SELECT dataset_id, row_id, label, text, -1 AS pass FROM raw
UNION ALL SELECT c.dataset_id, src_id, label, paraphrase, pass FROM chosen c JOIN need USING (dataset_id)
WHERE r <= needed"""
)
def paraphrase_balance(spark: SparkSession, sf: str) -> DataFrame:
    """The whole loop with a deterministic generator; original rows have pass -1."""
    generate = hooks.expression_generator(t.varied_word_drop)
    score = matching.matcher(t.token_vectors(spark, sf), keep=[*PAIR, "paraphrase", "label"])
    balanced = paraphrase.paraphrase_balance(t.examples(spark, sf, t.texts(spark, sf)), generate, score)
    return balanced.select("dataset_id", "row_id", "label", "text", F.coalesce("pass", F.lit(-1)).alias("pass"))


# ---- Comparison of strategies ---------------------------------------------------------------------------

WIDE = """wide AS (
  SELECT dataset_id,
         max(round(macro_f1, 4)) FILTER (strategy = 'baseline') AS baseline__macro_f1,
         max(round(abs(tpr_class_0 - tpr_class_1), 4)) FILTER (strategy = 'baseline') AS baseline__tpr_gap,
         max(round(macro_f1, 4)) FILTER (strategy = 'simple_oversampling') AS simple_oversampling__macro_f1,
         max(round(abs(tpr_class_0 - tpr_class_1), 4)) FILTER (strategy = 'simple_oversampling')
           AS simple_oversampling__tpr_gap
  FROM report GROUP BY ALL)"""
BOTH = ["baseline", "simple_oversampling"]


@query(sql.with_tables(sql.PREDICTIONS, sql.LABEL_SCORES, sql.REPORT, WIDE) + "SELECT * FROM wide")
def strategy_comparison(spark: SparkSession, sf: str) -> DataFrame:
    """Full outer join of the two strategies' results."""
    report = settle(metrics.fairness_report(t.predictions(spark, sf)), "report")
    return comparison.strategy_comparison(report, BOTH)


@query(sql.with_tables(sql.PREDICTIONS, sql.LABEL_SCORES, sql.REPORT, WIDE) + "SELECT * FROM wide")
def strategy_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """The same table by pivot."""
    report = metrics.fairness_report(t.predictions(spark, sf))
    return reshape.strategy_table(report, BOTH, ["macro_f1", "tpr_gap"])


@query(
    sql.with_tables(sql.PREDICTIONS, sql.LABEL_SCORES, sql.REPORT)
    + """SELECT dataset_id, strategy, unnest(['accuracy', 'macro_f1', 'tpr_gap']) AS metric,
       round(unnest([accuracy, macro_f1, abs(tpr_class_0 - tpr_class_1)]), 6) AS value FROM report"""
)
def metrics_long(spark: SparkSession, sf: str) -> DataFrame:
    report = metrics.fairness_report(t.predictions(spark, sf))
    long = reshape.metrics_long(report, ["dataset_id", "strategy"], ["accuracy", "macro_f1", "tpr_gap"])
    return long.withColumn("value", F.round("value", 6))


RATIOS = """ratios AS (
  SELECT dataset_id, max(n)::DOUBLE / min(n) AS imbalance_ratio FROM (
    SELECT lang || '/' || source AS dataset_id, toxic, count(*) AS n
    FROM documents JOIN labels USING (doc_id) GROUP BY ALL) GROUP BY dataset_id)"""


@query(
    sql.with_tables(sql.PREDICTIONS, sql.LABEL_SCORES, sql.REPORT, RATIOS)
    + """SELECT dataset_id, strategy, round(macro_f1, 6) AS macro_f1, round(imbalance_ratio, 6) AS imbalance_ratio
FROM report LEFT JOIN ratios USING (dataset_id)"""
)
def metrics_with_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics with the imbalance of another label."""
    labelled = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id")
    toxic = labelled.select(lab.dataset_key(F.col("lang"), F.col("source")).alias("dataset_id"), F.col("toxic").alias("label"))
    report = metrics.fairness_report(t.predictions(spark, sf))
    joined = reshape.metrics_with_ratio(report, profile.imbalance_summary(toxic))
    return joined.select(
        "dataset_id",
        "strategy",
        F.round("macro_f1", 6).alias("macro_f1"),
        F.round("imbalance_ratio", 6).alias("imbalance_ratio"),
    )


MEASURED = "measured AS (SELECT * FROM runs WHERE success AND elapsed_source = 'measured')"


@query(sql.with_tables(sql.JOB_RUNS, MEASURED) + "SELECT job_id, strategy, elapsed_seconds FROM measured")
def measured_runs(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.measured_only(t.job_runs(spark, sf)).select("job_id", "strategy", "elapsed_seconds")


@query(
    sql.with_tables(sql.JOB_RUNS, MEASURED)
    + """SELECT m.job_id, m.strategy, b.elapsed_seconds AS baseline_seconds, m.elapsed_seconds AS method_seconds,
       round(b.elapsed_seconds / m.elapsed_seconds, 3) AS speedup
FROM measured m JOIN measured b ON m.job_id = b.job_id AND b.strategy = 'baseline' WHERE m.strategy <> 'baseline'"""
)
def speedup(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.speedup(metrics.measured_only(t.job_runs(spark, sf)))


def _measured(spark: SparkSession, sf: str, strategy: str) -> DataFrame:
    return metrics.measured_only(t.job_runs(spark, sf)).where(F.col("strategy") == strategy).select("job_id")


SIDES = """base AS (SELECT job_id FROM measured WHERE strategy = 'baseline'),
over AS (SELECT job_id FROM measured WHERE strategy = 'simple_oversampling')"""


@query(
    sql.with_tables(sql.JOB_RUNS, MEASURED, SIDES)
    + """SELECT job_id, job_id IN (SELECT job_id FROM base) AS in_left, job_id IN (SELECT job_id FROM over) AS in_right
FROM (SELECT job_id FROM base UNION SELECT job_id FROM over)
WHERE job_id NOT IN (SELECT job_id FROM base INTERSECT SELECT job_id FROM over)"""
)
def missing_timings(spark: SparkSession, sf: str) -> DataFrame:
    left, right = (_measured(spark, sf, s) for s in BOTH)
    return joining.missing_keys(left, right, ["job_id"])


@query(
    sql.with_tables(sql.JOB_RUNS, MEASURED, SIDES)
    + """SELECT 'both' AS kind, job_id FROM (SELECT job_id FROM base INTERSECT SELECT job_id FROM over)
UNION ALL SELECT 'either', job_id FROM (SELECT job_id FROM base UNION SELECT job_id FROM over)
UNION ALL SELECT 'left only', job_id FROM (SELECT job_id FROM base EXCEPT SELECT job_id FROM over)
UNION ALL SELECT 'right only', job_id FROM (SELECT job_id FROM over EXCEPT SELECT job_id FROM base)"""
)
def key_sets(spark: SparkSession, sf: str) -> DataFrame:
    left, right = (_measured(spark, sf, s) for s in BOTH)
    return joining.key_sets(left, right, ["job_id"])


JOB_TABLE = """jobs AS (
  SELECT job_id AS dataset_id,
         max(elapsed_seconds) FILTER (strategy = 'baseline') AS baseline_value,
         max(elapsed_seconds) FILTER (strategy = 'simple_oversampling') AS method_value
  FROM runs GROUP BY job_id)"""


@query(
    sql.with_tables(sql.JOB_RUNS, MEASURED, SIDES, JOB_TABLE)
    + "SELECT * FROM jobs WHERE dataset_id IN (SELECT job_id FROM base INTERSECT SELECT job_id FROM over)"
)
def complete_only(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison rows restricted to the jobs measured under both strategies."""
    runs = t.job_runs(spark, sf)

    def value(strategy: str):
        return F.max(F.when(F.col("strategy") == strategy, F.col("elapsed_seconds")))

    jobs = runs.groupBy(F.col("job_id").alias("dataset_id")).agg(
        value("baseline").alias("baseline_value"), value("simple_oversampling").alias("method_value")
    )
    return comparison.timed_comparison(jobs, runs, "simple_oversampling")


def _published(spark: SparkSession, sf: str) -> DataFrame:
    """Reports as nested documents, baseline first."""
    report = metrics.fairness_report(t.predictions(spark, sf))
    entry = F.struct(F.col("strategy").alias("method"), "macro_f1", "tpr_gap", F.col("accuracy").alias("speedup"))
    return report.groupBy(F.col("dataset_id").alias("dataset")).agg(F.sort_array(F.collect_list(entry)).alias("methods"))


@query(
    sql.with_tables(sql.PREDICTIONS, sql.LABEL_SCORES, sql.REPORT)
    + """SELECT dataset_id AS dataset, strategy AS method, round(macro_f1, 6) AS macro_f1,
       round(abs(tpr_class_0 - tpr_class_1), 6) AS tpr_gap FROM report WHERE strategy IN ('simple_oversampling', 'baseline')"""
)
def published_methods(spark: SparkSession, sf: str) -> DataFrame:
    methods = reshape.select_methods(reshape.flatten_methods(_published(spark, sf)), ["simple_oversampling", "baseline"])
    return methods.select("dataset", "method", F.round("macro_f1", 6).alias("macro_f1"), F.round("tpr_gap", 6).alias("tpr_gap"))


@query(
    sql.with_tables(sql.PREDICTIONS, sql.LABEL_SCORES, sql.REPORT)
    + """SELECT dataset_id AS dataset, round(macro_f1, 6) AS macro_f1,
       round(abs(tpr_class_0 - tpr_class_1), 6) AS tpr_gap, round(accuracy, 6) AS speedup
FROM report WHERE strategy = 'baseline'"""
)
def published_baseline(spark: SparkSession, sf: str) -> DataFrame:
    found = reshape.published_baseline(_published(spark, sf))
    return found.select("dataset", *[F.round(c, 6).alias(c) for c in ("macro_f1", "tpr_gap", "speedup")])


# ---- Upserts and lookups --------------------------------------------------------------------------------


@query(
    """WITH counts AS (
  SELECT 'lang/' || lang AS dataset_id, quality, count(*) AS n FROM documents JOIN labels USING (doc_id)
  WHERE lang IN ('en', 'fr') GROUP BY ALL
  UNION ALL
  SELECT 'lang/' || lang, toxic, count(*) FROM documents JOIN labels USING (doc_id)
  WHERE lang NOT IN ('en', 'fr') GROUP BY ALL)
SELECT dataset_id, sum(n)::BIGINT AS total, round(max(n)::DOUBLE / min(n), 6) AS imbalance_ratio,
       coalesce(max(n) FILTER (quality = 0), 0) AS n_0, coalesce(max(n) FILTER (quality = 1), 0) AS n_1
FROM counts GROUP BY dataset_id"""
)
def upsert_distribution(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue of toxicity counts, with English and French replaced by quality counts."""
    joined = t.table(spark, sf, "documents").join(t.table(spark, sf, "labels"), "doc_id")
    rows = joined.withColumn("dataset_id", lab.dataset_key(F.lit("lang"), F.col("lang")))
    old = profile.distribution_entry(rows, label="toxic")
    new = profile.distribution_entry(rows.where(F.col("lang").isin("en", "fr")), label="quality")
    out = upsert.upsert_distribution(old, new)
    return out.select(
        "dataset_id",
        "total",
        F.round("imbalance_ratio", 6).alias("imbalance_ratio"),
        *[F.coalesce(F.try_element_at("counts", F.lit(str(i))), F.lit(0)).alias(f"n_{i}") for i in (0, 1)],
    )


EDGES = """edges AS (
  SELECT o_custkey,
         arg_min(struct_pack(s := o_orderstatus, p := o_totalprice),
                 struct_pack(d := o_orderdate, k := o_orderkey)) AS first,
         arg_max(struct_pack(s := o_orderstatus, p := o_totalprice),
                 struct_pack(d := o_orderdate, k := o_orderkey)) AS last
  FROM orders GROUP BY o_custkey)"""


def _order_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's first and last order."""
    value, when = F.struct("o_orderstatus", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")
    return (
        t.table(spark, sf, "orders")
        .groupBy("o_custkey")
        .agg(F.min_by(value, when).alias("first"), F.max_by(value, when).alias("last"))
    )


@query(
    sql.with_tables(EDGES)
    + """SELECT 'cust/' || o_custkey AS job_id, CASE WHEN last.s = 'P' THEN first.s <> 'F' ELSE last.s <> 'F' END AS success,
       CASE WHEN last.s = 'P' THEN first.p ELSE last.p END AS elapsed_seconds FROM edges"""
)
def upsert_runs(spark: SparkSession, sf: str) -> DataFrame:
    """First orders are the log, last orders the new runs; status P is a skipped run, F a failed one."""
    edges = _order_edges(spark, sf).withColumn("job_id", F.concat(F.lit("cust/"), "o_custkey"))

    def runs(side: str) -> DataFrame:
        return edges.select(
            "job_id",
            (F.col(f"{side}.o_orderstatus") != "F").alias("success"),
            F.col(f"{side}.o_totalprice").alias("elapsed_seconds"),
            (F.col(f"{side}.o_orderstatus") == "P").alias("skipped"),
        )

    return upsert.upsert_runs(runs("first").drop("skipped"), runs("last"))


@query(
    sql.with_tables(EDGES)
    + """SELECT 'cust/' || o_custkey AS dataset_id, CASE WHEN last.s <> 'F' THEN last.p ELSE first.p END AS macro_f1
FROM edges WHERE first.s <> 'O' OR last.s <> 'F'"""
)
def upsert_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """First orders (without status O) are the log, last orders the evaluations; status F is a failed one."""
    edges = _order_edges(spark, sf).withColumn("dataset_id", F.concat(F.lit("cust/"), "o_custkey"))
    old = edges.where(F.col("first.o_orderstatus") != "O").select("dataset_id", F.col("first.o_totalprice").alias("macro_f1"))
    new = edges.select(
        "dataset_id",
        F.col("last.o_totalprice").alias("macro_f1"),
        (F.col("last.o_orderstatus") != "F").alias("success"),
    )
    return upsert.upsert_metrics(old, new)


@query(
    """SELECT DISTINCT o_custkey AS key, CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 1 END AS source_no,
       CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal ELSE c_nationkey::DOUBLE END AS value
FROM orders JOIN customer ON o_custkey = c_custkey"""
)
def lookup_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Customers of orders, looked up in one segment first and among all customers after that."""
    customers = t.table(spark, sf, "customer").withColumnRenamed("c_custkey", "key")
    near = customers.where(F.col("c_mktsegment") == "BUILDING").select("key", F.col("c_acctbal").alias("value"))
    far = customers.select("key", F.col("c_nationkey").cast("double").alias("value"))
    wanted = t.table(spark, sf, "orders").select(F.col("o_custkey").alias("key")).distinct()
    return upsert.lookup_with_fallback(wanted, [near, far], ["key"])


# ---- Models ---------------------------------------------------------------------------------------------


BAYES = f"""strategies AS (
  SELECT 'baseline' AS strategy, dataset_id, row_id, label FROM parts WHERE split = 'train'
  UNION ALL SELECT 'simple_oversampling', dataset_id, row_id, label FROM doubled),
priors AS (
  SELECT dataset_id, strategy, label, n, ln(n::DOUBLE / sum(n) OVER (PARTITION BY dataset_id, strategy)) AS prior
  FROM (SELECT dataset_id, strategy, label, count(*) AS n FROM strategies GROUP BY ALL)),
texts AS (SELECT row_id, {sql.tokens('text')} AS w FROM raw),
learned AS MATERIALIZED (
  SELECT dataset_id, strategy, label, token, count(*) AS c
  FROM (SELECT s.*, unnest(w) AS token FROM strategies s JOIN texts USING (row_id)) GROUP BY ALL),
totals AS (SELECT dataset_id, strategy, label, sum(c) AS total FROM learned GROUP BY ALL),
kinds AS (SELECT dataset_id, strategy, count(DISTINCT token) AS v FROM learned GROUP BY ALL),
test_words AS (
  SELECT dataset_id, row_id, token, count(*) AS n FROM (
    SELECT dataset_id, row_id, unnest(w) AS token FROM parts JOIN texts USING (row_id) WHERE split = 'test') GROUP BY ALL),
lengths AS (
  SELECT dataset_id, row_id, parts.label AS y_true, len(w) AS n FROM parts JOIN texts USING (row_id) WHERE split = 'test'),
hits AS (
  SELECT dataset_id, strategy, row_id, label, sum(n * ln(c + 1.0::DOUBLE)) AS s
  FROM test_words JOIN learned USING (dataset_id, token) GROUP BY ALL),
scores_nb AS (
  SELECT l.dataset_id, p.strategy, l.row_id, y_true, p.label,
         prior + coalesce(s, 0) - l.n * ln(coalesce(total, 0) + coalesce(v, 0) + 1.0::DOUBLE) AS score
  FROM lengths l JOIN priors p USING (dataset_id)
  LEFT JOIN totals t ON t.dataset_id = p.dataset_id AND t.strategy = p.strategy AND t.label = p.label
  LEFT JOIN kinds k ON k.dataset_id = p.dataset_id AND k.strategy = p.strategy
  LEFT JOIN hits h ON h.dataset_id = p.dataset_id AND h.strategy = p.strategy AND h.row_id = l.row_id AND h.label = p.label),
predictions AS (
  SELECT dataset_id, strategy, row_id, y_true, label AS y_pred FROM scores_nb
  QUALIFY row_number() OVER (PARTITION BY dataset_id, strategy, row_id ORDER BY score DESC, label) = 1)"""


@query(
    sql.with_tables(
        sql.RAW,
        f"parts AS ({_split_sql('raw')})",
        "train AS (SELECT * FROM parts WHERE split = 'train')",
        _duplicate_sql("train"),
        BAYES,
        sql.LABEL_SCORES,
        sql.REPORT,
    )
    + """SELECT dataset_id, strategy, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(tpr_class_0, 6) AS tpr_class_0, round(tpr_class_1, 6) AS tpr_class_1,
       round(abs(tpr_class_0 - tpr_class_1), 6) AS tpr_gap FROM report"""
)
def fit_and_evaluate(spark: SparkSession, sf: str) -> DataFrame:
    """Classifiers per language and strategy, fitted as one job and judged on the same test part."""
    rows = settle(splits.train_test_split(t.examples(spark, sf, t.texts(spark, sf))), "split")
    train, test = rows.where(F.col("split") == "train").drop("split"), rows.where(F.col("split") == "test").drop("split")
    doubled = balance.duplicate_minority(train).drop("copy")
    both = train.withColumn("strategy", F.lit("baseline")).unionByName(doubled.withColumn("strategy", F.lit("simple_oversampling")))
    report = metrics.fairness_report(settle(training.bayes_predictions(settle(both, "train"), test), "predictions"))
    return report.select("dataset_id", "strategy", *[F.round(c, 6).alias(c) for c in ROUNDED])

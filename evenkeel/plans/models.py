"""Registered queries that fit classifiers step by step, store them and judge the stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.operators import balance, logistic, splits
from evenkeel.plans import fragments as sql
from evenkeel.plans import tables as t
from evenkeel.plans.queries import ROUNDED, _duplicate_sql, _split_sql
from evenkeel.plans.registry import query
from evenkeel.workspace import new_path, settle

#: Small enough for SQL to repeat the steps.
SMALL = {"slots": 16, "steps": 6, "patience": 2, "rate": 3.0, "decay": 0.001}


def _steps_sql() -> str:
    """The steps of ``logistic.fit`` in SQL; ``weights`` is the table of best weights."""
    slots, steps, patience, rate, decay = SMALL.values()
    key = "dataset_id, strategy"
    parts = [
        f"""strategies AS (
  SELECT 'baseline' AS strategy, dataset_id, row_id, 0 AS copy, label, {sql.order_key("'42:val:' || row_id")} AS k FROM train
  UNION ALL SELECT 'simple_oversampling', dataset_id, row_id, copy, label, {sql.order_key("'42:val:' || row_id || ':' || copy")} FROM doubled),
given AS (
  SELECT {key}, row_id || ':' || copy AS rid, row_id, label,
         row_number() OVER (PARTITION BY {key} ORDER BY k, row_id, copy)
         <= greatest(1, count(*) OVER (PARTITION BY {key}) // 10) AS val FROM strategies),
counted AS MATERIALIZED (
  SELECT row_id, slot, count(*) AS c FROM (
    SELECT row_id, ('0x' || substr(md5(token), 1, 15))::BIGINT % {slots} AS slot
    FROM (SELECT row_id, unnest({sql.tokens('text')}) AS token FROM raw)) GROUP BY ALL),
vectors AS MATERIALIZED (
  SELECT row_id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY row_id)) AS x FROM counted
  UNION ALL SELECT row_id, {slots}, 1.0::DOUBLE FROM raw),
feats AS MATERIALIZED (SELECT {key}, rid, label, val, slot, x FROM given JOIN vectors USING (row_id)),
sizes AS (SELECT {key}, count(*) FILTER (NOT val) AS n FROM given GROUP BY ALL),
w0 AS MATERIALIZED (SELECT {key}, slot, 0.0::DOUBLE AS w FROM sizes, range({slots + 1}) r(slot))"""
    ]
    for i in range(steps + 1):
        parts.append(f"""m{i} AS MATERIALIZED (
  SELECT {key}, rid, label, val, sum(x * w) AS m FROM feats JOIN w{i} USING ({key}, slot) GROUP BY ALL),
l{i} AS (
  SELECT {key}, {i} AS step, avg(ln(1 + exp(-abs(m))) + greatest(m, 0) - label * m) AS loss FROM m{i} WHERE val GROUP BY ALL)""")
        if i < steps:
            parts.append(f"""w{i + 1} AS MATERIALIZED (
  SELECT {key}, slot, w - {rate}::DOUBLE * coalesce(g, 0) / n
         - CASE WHEN slot < {slots} THEN {rate}::DOUBLE * {decay}::DOUBLE * w ELSE 0 END AS w
  FROM w{i} JOIN sizes USING ({key}) LEFT JOIN (
    SELECT {key}, slot, sum(x * (1 / (1 + exp(-m)) - f.label)) AS g
    FROM feats f JOIN m{i} USING ({key}, rid) WHERE NOT f.val GROUP BY ALL) USING ({key}, slot))""")
    losses = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, steps + 1))
    every = " UNION ALL ".join(f"SELECT *, {i} AS best_step FROM w{i}" for i in range(steps + 1))
    parts.append(f"""losses AS (SELECT * FROM ({losses})),
judged AS (
  SELECT *, coalesce(loss < min(loss) OVER (PARTITION BY {key} ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
         AS better FROM losses),
last AS (SELECT *, max(CASE WHEN better THEN step END) OVER (PARTITION BY {key} ORDER BY step) AS best FROM judged),
ends AS (SELECT {key}, min(step) AS steps FROM last WHERE step - best >= {patience} OR step = {steps} GROUP BY ALL),
chosen AS (
  SELECT l.dataset_id, l.strategy, e.steps, l.best AS best_step FROM last l
  JOIN ends e ON e.dataset_id = l.dataset_id AND e.strategy = l.strategy AND e.steps = l.step),
every AS ({every}),
weights AS (SELECT {key}, slot, w, steps, best_step FROM every JOIN chosen USING ({key}, best_step))""")
    return ",\n".join(parts)


FITTED = (sql.RAW, f"parts AS ({_split_sql('raw')})", "train AS (SELECT * FROM parts WHERE split = 'train')", _duplicate_sql("train"), _steps_sql())


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Training rows of two strategies with their validation part, and the untouched test rows."""
    rows = settle(splits.train_test_split(t.examples(spark, sf, t.texts(spark, sf))), "split")
    train, test = rows.where("split = 'train'").drop("split"), rows.where("split = 'test'").drop("split")
    doubled = balance.duplicate_minority(train)
    parts = {
        "baseline": splits.train_val_split(train),
        "simple_oversampling": splits.train_val_split(doubled, row=("row_id", "copy")).drop("copy"),
    }
    both = [part.withColumn("strategy", F.lit(name)) for name, part in parts.items()]
    return both[0].unionByName(both[1]), test


@query(
    sql.with_tables(*FITTED)
    + """SELECT dataset_id, strategy, slot::INT AS slot, round(w, 6) AS weight, steps, best_step, round(loss, 6) AS val_loss
FROM weights JOIN losses l USING (dataset_id, strategy) WHERE l.step = best_step"""
)
def fit_with_validation(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the best step of every language and strategy, each stopped by its own validation part."""
    train, _ = _parts(spark, sf)
    models = logistic.fit(train, **SMALL)
    numbered = models.select("dataset_id", "strategy", "steps", "best_step", "val_loss", F.posexplode("weights").alias("slot", "w"))
    return numbered.select(
        "dataset_id", "strategy", "slot", F.round("w", 6).alias("weight"), "steps", "best_step", F.round("val_loss", 6).alias("val_loss")
    )


@query(
    sql.with_tables(
        *FITTED,
        """predictions AS (
  SELECT dataset_id, strategy, row_id, y_true, CASE WHEN m > 0 THEN 1 ELSE 0 END AS y_pred FROM (
    SELECT w.dataset_id, w.strategy, p.row_id, p.label AS y_true, sum(x * w) AS m
    FROM parts p JOIN vectors v USING (row_id) JOIN weights w ON w.dataset_id = p.dataset_id AND w.slot = v.slot
    WHERE split = 'test' GROUP BY ALL))""",
        sql.LABEL_SCORES,
        sql.REPORT,
    )
    + """SELECT dataset_id, strategy, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(tpr_class_0, 6) AS tpr_class_0, round(tpr_class_1, 6) AS tpr_class_1,
       round(abs(tpr_class_0 - tpr_class_1), 6) AS tpr_gap FROM report"""
)
def evaluate_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Models fitted and stored in two runs, of which the second fits what the first has not, then read and judged on the test part."""
    path = new_path(spark, "stored-models")
    train, test = _parts(spark, sf)
    logistic.fit_missing(train.where("strategy = 'baseline'"), path, **SMALL)
    logistic.fit_missing(train, path, **SMALL)
    return logistic.evaluate(test, path).select("dataset_id", "strategy", *[F.round(c, 6).alias(c) for c in ROUNDED])

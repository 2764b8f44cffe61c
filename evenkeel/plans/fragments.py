"""SQL for the shapes in ``tables``, to put the checks together."""

from evenkeel.constants import (
    BLEU_ENTITIES,
    BLEU_REPLACEMENTS,
    BLEU_RULES,
    MIN_LENGTH_RATIO,
    MIN_WORD_OVERLAP,
    SPACE_CLASS,
    STOP_WORDS,
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_tables(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, {quoted(SPACE_CLASS + '+')}), lambda w: w <> '')"


def tokens(text: str) -> str:
    return words(f"lower({text})")


STOP = "[" + ", ".join(quoted(w) for w in STOP_WORDS) + "]"


def content(token_list: str) -> str:
    return f"list_distinct(list_filter({token_list}, lambda w: NOT list_contains({STOP}, w) AND length(w) > 1))"


def order_key(seed_and_id: str) -> str:
    return f"substr(md5({seed_and_id}), 1, 15)"


def f1(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} > 0 THEN 2 * {p} * {r} / ({p} + {r}) ELSE 0.0::DOUBLE END"


RAW = """raw AS (
  SELECT 'lang/' || lang AS dataset_id, doc_id AS row_id, text, quality AS label
  FROM documents JOIN labels USING (doc_id))"""

EVERYTHING = """everything AS (
  SELECT 'lang/' || lang AS dataset_id, doc_id AS row_id, text, coalesce(quality, -1) AS label
  FROM documents LEFT JOIN labels USING (doc_id))"""

EVENTS = """stream AS (
  SELECT 'events/stream' AS dataset_id, event_id AS row_id, event_type AS text,
         CASE WHEN event_id % 40 = 0 THEN 0 ELSE 1 END AS label
  FROM events)"""

REVIEWS = """reviews AS (
  SELECT (CAST(l_quantity AS INT) % 5 + 1)::DOUBLE AS overall,
         CASE WHEN l_linenumber = 1 THEN '' ELSE l_returnflag END AS reviewText
  FROM lineitem)"""

PREDICTIONS = """predictions AS (
  SELECT lang || '/' || source AS dataset_id, 'baseline' AS strategy, doc_id AS row_id, quality AS y_true,
         CASE WHEN doc_id % 3 = 0 THEN 1 ELSE quality END AS y_pred
  FROM documents JOIN labels USING (doc_id)
  UNION ALL
  SELECT lang || '/' || source, 'simple_oversampling', doc_id, quality,
         CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END
  FROM documents JOIN labels USING (doc_id))"""

# Per label occurring as truth or as prediction.
LABEL_SCORES = """sides AS (
  SELECT DISTINCT dataset_id, strategy, y_true AS label FROM predictions
  UNION SELECT DISTINCT dataset_id, strategy, y_pred FROM predictions),
scores AS (
  SELECT s.dataset_id, s.strategy, s.label,
         count(*) FILTER (y_true = s.label AND y_pred = s.label) AS tp,
         count(*) FILTER (y_true = s.label) AS support,
         count(*) FILTER (y_pred = s.label) AS predicted
  FROM sides s JOIN predictions p ON p.dataset_id = s.dataset_id AND p.strategy = s.strategy
  GROUP BY ALL)"""

REPORT = """report AS (
  SELECT a.*, m.macro_f1 FROM (
    SELECT dataset_id, strategy, avg((y_true = y_pred)::INT) AS accuracy,
           CASE WHEN count(*) FILTER (y_true = 0) > 0
                THEN count(*) FILTER (y_true = 0 AND y_pred = 0)::DOUBLE / count(*) FILTER (y_true = 0)
                ELSE 0 END AS tpr_class_0,
           CASE WHEN count(*) FILTER (y_true = 1) > 0
                THEN count(*) FILTER (y_true = 1 AND y_pred = 1)::DOUBLE / count(*) FILTER (y_true = 1)
                ELSE 0 END AS tpr_class_1
    FROM predictions GROUP BY ALL) a
  JOIN (SELECT dataset_id, strategy, avg(2.0::DOUBLE * tp / (support + predicted)) AS macro_f1
        FROM scores GROUP BY ALL) m USING (dataset_id, strategy))"""

ORIGINALS = """originals AS (
  SELECT 'lang/' || lang AS dataset_id, doc_id AS src_id, text, coalesce(quality, -1) AS label
  FROM documents LEFT JOIN labels USING (doc_id))"""


def spoken(passes: int) -> str:
    """Generated texts of the first passes, next to their originals."""
    w = words("text")
    return f"""split_texts AS MATERIALIZED (SELECT *, {w} AS w FROM originals),
pairs AS MATERIALIZED (
  SELECT dataset_id, src_id, pass::INT AS pass, label, text AS original,
         array_to_string(CASE (src_id + pass) % 4
           WHEN 0 THEN list_filter(w, lambda x, i: (i - 1 + pass) % 5 = 0)
           WHEN 1 THEN list_filter(w, lambda x, i: (i - 1 + pass) % 2 = 0)
           ELSE list_filter(w, lambda x, i: (i - 1 + pass) % 5 <> 0) END, ' ') AS paraphrase
  FROM split_texts, range({passes}) r(pass))"""


FEATURES = f"""pair_tokens AS (
  SELECT *, {tokens('paraphrase')} AS p, {tokens('original')} AS o FROM pairs),
pair_words AS (
  SELECT *, {content('p')} AS pc, {content('o')} AS oc FROM pair_tokens),
measured AS (
  SELECT *, CASE WHEN len(o) > 0 THEN len(p)::DOUBLE / len(o) END AS length_ratio,
         CASE WHEN len(oc) > 0 THEN len(list_intersect(pc, oc))::DOUBLE / len(oc) END AS content_overlap
  FROM pair_words),
features AS (
  SELECT *, CASE WHEN length_ratio IS NULL THEN true
                 WHEN length_ratio < {MIN_LENGTH_RATIO} THEN false
                 WHEN content_overlap IS NULL THEN true
                 ELSE content_overlap >= {MIN_WORD_OVERLAP} END AS is_valid
  FROM measured)"""

VECTORS = """sizes AS (SELECT count(*) AS n FROM embeddings),
sims AS MATERIALIZED (
  SELECT a.vec_id AS a_id, b.vec_id AS b_id,
         list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine
  FROM embeddings a, embeddings b)"""


def scored(source: str) -> str:
    """Greedy matching of the pairs in ``source``: the best cosine of each distinct token, weighted by count."""
    return f"""{VECTORS},
token_rows AS (
  SELECT dataset_id, src_id, pass, 0 AS side, unnest({tokens('paraphrase')}) AS token FROM {source}
  UNION ALL
  SELECT dataset_id, src_id, pass, 1, unnest({tokens('original')}) FROM {source}),
kinds AS MATERIALIZED (
  SELECT dataset_id, src_id, pass, side, token, count(*) AS n,
         ('0x' || substr(md5(token), 1, 15))::BIGINT % (SELECT n FROM sizes) AS vec_id
  FROM token_rows GROUP BY ALL),
lonely AS (
  SELECT a.* FROM kinds a ANTI JOIN kinds b
    ON a.dataset_id = b.dataset_id AND a.src_id = b.src_id AND a.pass = b.pass
   AND a.side = 1 - b.side AND a.token = b.token),
lonely_best AS (
  SELECT a.dataset_id, a.src_id, a.pass, a.side, a.token, greatest(max(cosine), 0.0) AS best
  FROM lonely a JOIN kinds b
    ON a.dataset_id = b.dataset_id AND a.src_id = b.src_id AND a.pass = b.pass AND a.side = 1 - b.side
  JOIN sims ON a_id = a.vec_id AND b_id = b.vec_id
  GROUP BY ALL),
means AS (
  SELECT k.dataset_id, k.src_id, k.pass,
         sum(k.n * CASE WHEN l.token IS NULL THEN 1.0 ELSE b.best END) FILTER (k.side = 0)
           / sum(k.n) FILTER (k.side = 0) AS p,
         sum(k.n * CASE WHEN l.token IS NULL THEN 1.0 ELSE b.best END) FILTER (k.side = 1)
           / sum(k.n) FILTER (k.side = 1) AS r
  FROM kinds k
  LEFT JOIN lonely l USING (dataset_id, src_id, pass, side, token)
  LEFT JOIN lonely_best b USING (dataset_id, src_id, pass, side, token)
  GROUP BY ALL),
scored AS (
  SELECT s.*, CASE WHEN means.p IS NULL OR means.r IS NULL OR means.p + means.r = 0 THEN 0.0::DOUBLE
                   ELSE 2.0 * means.p * means.r / (means.p + means.r) END AS score
  FROM {source} s LEFT JOIN means USING (dataset_id, src_id, pass))"""


def bleu_words(text: str) -> str:
    for old, new in BLEU_REPLACEMENTS + BLEU_ENTITIES:
        if "\n" in old:
            text = f"replace({text}, {quoted(old[:-1])} || chr(10), {quoted(new)})"
        else:
            text = f"replace({text}, {quoted(old)}, {quoted(new)})"
    for pattern, template in BLEU_RULES:
        java_to_sql = template.replace("$", "\\")
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(java_to_sql)}, 'g')"
    return words(text)


def bleu(source: str) -> str:
    return f"""split_pairs AS MATERIALIZED (
  SELECT dataset_id, pass, src_id, {bleu_words('paraphrase')} AS h, {bleu_words('original')} AS r FROM {source}),
word_rows AS (
  SELECT dataset_id, pass, src_id, 1 AS ours, unnest(h) AS w, generate_subscripts(h, 1) AS pos FROM split_pairs
  UNION ALL
  SELECT dataset_id, pass, src_id, 0, unnest(r), generate_subscripts(r, 1) FROM split_pairs),
next_words AS (
  SELECT *, lead(w, 1) OVER text_order AS w2, lead(w, 2) OVER text_order AS w3, lead(w, 3) OVER text_order AS w4
  FROM word_rows WINDOW text_order AS (PARTITION BY dataset_id, pass, src_id, ours ORDER BY pos)),
gram_rows AS (
  SELECT dataset_id, pass, src_id, ours, 1 - ours AS theirs,
         unnest([1, 2, 3, 4]) AS n,
         unnest([w, w || ' ' || w2, w || ' ' || w2 || ' ' || w3, w || ' ' || w2 || ' ' || w3 || ' ' || w4]) AS gram
  FROM next_words),
grams AS (
  SELECT dataset_id, pass, src_id, n, gram, sum(ours) AS ours, sum(theirs) AS theirs
  FROM gram_rows WHERE gram IS NOT NULL GROUP BY ALL),
orders_n AS (
  SELECT dataset_id, pass, n, sum(least(ours, theirs)) AS m, sum(ours) AS h, sum(theirs) AS r
  FROM grams GROUP BY ALL),
bleu AS (
  SELECT dataset_id, pass, max(h) FILTER (n = 1) AS hypothesis_length, max(r) FILTER (n = 1) AS reference_length,
         CASE WHEN count(*) FILTER (m > 0) < 4 THEN 0.0::DOUBLE
              ELSE 100.0 * exp(avg(CASE WHEN m > 0 THEN ln(m::DOUBLE / h) END))
                 * CASE WHEN max(h) FILTER (n = 1) > max(r) FILTER (n = 1) THEN 1.0
                        ELSE exp(1.0 - max(r) FILTER (n = 1)::DOUBLE / max(h) FILTER (n = 1)) END END AS bleu
  FROM orders_n GROUP BY ALL)"""


JOB_RUNS = """runs AS (
  SELECT job_id, strategy, v.o_orderstatus <> 'F' AS success, v.o_totalprice AS elapsed_seconds,
         CASE WHEN length(job_id) % 2 = 0 THEN 'measured' ELSE 'estimated' END AS elapsed_source
  FROM (
    SELECT 'cust/' || o_custkey AS job_id,
           CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'baseline' WHEN '2' THEN 'simple_oversampling'
                WHEN '3' THEN 'llm_paraphrasing' ELSE 'undersampling' END AS strategy,
           arg_max(struct_pack(o_orderstatus := o_orderstatus, o_totalprice := o_totalprice),
                   struct_pack(o_orderdate := o_orderdate, o_orderkey := o_orderkey)) AS v
    FROM orders GROUP BY ALL))"""

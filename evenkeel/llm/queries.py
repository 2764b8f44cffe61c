"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evenkeel.llm import (
    chat,
    decontaminate,
    embeddings,
    html_text,
    language,
    lines,
    merkle,
    mixing,
    near_duplicates,
    packing,
    quality,
    token_files,
    whitening,
)
from evenkeel.llm.common import held_out

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        LLM_QUERIES[fn.__name__] = fn
        if sql is not None:
            LLM_SQL[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out()), key=F.col("doc_id"))
    return language.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)


@query()
def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP3_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
items AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id,
           regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS k
    FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
          FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
    SELECT doc_id, size, i, array_to_string(list_slice(w, i, i + size - 1), ' ') AS k
    FROM (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM words, sizes WHERE len(w) >= size)),
found AS (SELECT doc_id, item_id, i, places.size FROM places JOIN windows USING (size, k)),
hits AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM found))
    GROUP BY doc_id),
named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT words.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query(OP3_SQL)
def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    matched = decontaminate.match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    n_hit = decontaminate.hit_words()
    return matched.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query()
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page, laid out."""
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "html"))


OP5_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
                                 ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
    FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
pairs AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * c >= 85 * (x.n + y.n - c)),
links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
parts AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM parts LEFT JOIN sizes USING (doc_id)
"""


@query(OP5_SQL)
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose five-word shingles are alike to 0.85 or more."""
    grouped = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))
    return grouped.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in the flat files that hold all documents' identifiers."""
    index = token_files.write_token_files(table(spark, sf_dir, "documents"))
    files = index.groupBy("path").agg(F.max("n_bytes").alias("n_bytes"))
    counts = token_files.count_tokens(files)
    return index.join(counts, ["path", "ordinal"]).select("doc_id", F.col("n_tokens"))


@query()
def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that occur before, exactly or nearly."""
    return lines.deduplicate(table(spark, sf_dir, "documents"), bits=10, few=24)


OP8_SQL = """
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
parts AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM parts LEFT JOIN counts USING (vec_id)
"""


@query(OP8_SQL)
def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of vectors of one label whose cosine is 0.98 or more."""
    grouped = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    return grouped.select("*", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query()
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), learn=~held_out("key"))
    scored = quality.score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query()
def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into rows of 2,048 identifiers."""
    return packing.pack(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE texts AS (
    SELECT doc_id, coalesce('=' || source, '') AS s,
           concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END,
                  CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
                  CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
                  CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END) AS head,
           CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS stored,
           CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' ||
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS lowered,
           xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
               lambda crc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(crc, b)),
               4294967295), 4294967295) % 5 = 0 AS tampered
    FROM documents),
leaves AS (
    SELECT doc_id, s, leaf, CASE WHEN tampered THEN sha256(head || lowered) ELSE leaf END AS given,
           row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY s) AS n
    FROM (SELECT *, sha256(head || stored) AS leaf FROM texts)),
nodes AS (
    SELECT s, 0 AS level, idx, leaf AS digest, n FROM leaves
    UNION ALL
    SELECT s, level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16
    FROM nodes WHERE n > 1 GROUP BY s, level, n, idx // 16),
subroots AS (
    SELECT s, digest AS subroot, row_number() OVER (ORDER BY s) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
    SELECT 0 AS level, idx, subroot AS digest, n FROM subroots
    UNION ALL
    SELECT level + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (n + 15) // 16
    FROM tops WHERE n > 1 GROUP BY level, n, idx // 16),
runs AS (SELECT s, level, idx // 16 AS run, list(digest ORDER BY idx) AS d FROM nodes WHERE n > 1 GROUP BY s, level, idx // 16),
top_runs AS (SELECT level, idx // 16 AS run, list(digest ORDER BY idx) AS d FROM tops WHERE n > 1 GROUP BY level, idx // 16),
steps AS (
    SELECT l.s, l.idx, r.level, array_to_string(d[1:p], '') AS before, array_to_string(d[p + 2:], '') AS after
    FROM (SELECT l.s, l.idx, r.level, r.d, (l.idx // CAST(pow(16, r.level) AS BIGINT)) % 16 AS p
          FROM leaves l JOIN runs r ON l.s = r.s AND r.run = l.idx // CAST(pow(16, r.level + 1) AS BIGINT)) r, LATERAL (SELECT r.s, r.idx) l
    UNION ALL
    SELECT s, idx, 100 + level, array_to_string(d[1:p], ''), array_to_string(d[p + 2:], '')
    FROM (SELECT l.s, l.idx, t.level, t.d, (r.idx // CAST(pow(16, t.level) AS BIGINT)) % 16 AS p
          FROM leaves l JOIN subroots r USING (s) JOIN top_runs t ON t.run = r.idx // CAST(pow(16, t.level + 1) AS BIGINT))),
paths AS (
    SELECT s, idx, string_agg(before || after, '' ORDER BY level) AS siblings, list(before || ',' || after ORDER BY level) AS way
    FROM steps GROUP BY s, idx),
folded AS (
    SELECT leaves.*, coalesce(siblings, '') AS siblings,
           coalesce(list_reduce(way, lambda acc, w: sha256(concat(split_part(w, ',', 1), acc, split_part(w, ',', 2))), given), given) AS folded_root
    FROM leaves LEFT JOIN paths USING (s, idx))
SELECT doc_id, leaf, subroot, (SELECT digest FROM tops WHERE n = 1) AS root, sha256(siblings) AS proof_sha256, folded_root,
       folded_root = (SELECT digest FROM tops WHERE n = 1) AS verified
FROM folded JOIN subroots USING (s)
"""


@query(OP11_SQL)
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; those whose id's checksum is divisible by five are checked with a lower-cased text."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    proved = merkle.manifest(table(spark, sf_dir, "documents"), checked=F.when(tampered, merkle.lower_ascii(F.col("text"))))
    folded = proved.withColumn("folded_root", merkle.fold(F.col("check_leaf"), F.col("segments")))
    return folded.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.siblings_text(F.col("segments")), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@query()
def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings, as whole numbers of 64ths."""
    rows = table(spark, sf_dir, "embeddings")
    return whitening.apply(rows, whitening.fit(rows))


@query()
def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the formatted windows of all conversations, and of one made of control strings, say when they are read back."""
    said = F.lit("</s>[INST] ok [/INST]")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(chat.format_windows(rows.unionByName(extra)))

"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stammwerk.llm import bpe, components, leakage, name_links, shared_spans, truncation
from stammwerk.sources.tables import table


#: The folder with the public vocabulary files.
TOKENIZERS = os.environ.get("STAMMWERK_TOKENIZERS", "/opt/tokenizers")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = table(spark, root, "match_pairs").select(*(components.material_key(F.col(c)).alias(c) for c in ("left_schluessel", "right_schluessel")))
    groups = components.connected_groups(pairs, "left_schluessel", "right_schluessel")
    return groups.select(F.col("group").alias("cluster_id"), F.col("key").alias("schluessel"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return truncation.judged(table(spark, root, "makt"), "row_id", "system_id", "maktx").filter("cut").select("row_id")


def p5_report(spark: SparkSession, root: str) -> DataFrame:
    return truncation.report(table(spark, root, "makt"), "row_id", "system_id", "maktx").withColumnRenamed("source", "system_id")


def _partners(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "candidates").select(F.col("schluessel").alias("key"), "name", F.col("stras").alias("street"), F.col("plz").alias("postcode"), F.col("ort").alias("city"), F.col("ustid").alias("vat"), (F.col("stkzn") == "X").alias("person"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = name_links.entity_pairs(name_links.linked_names(_partners(spark, root)))
    return pairs.select(F.col("key_a").alias("schluessel_a"), F.col("key_b").alias("schluessel_b"))


def p7_entities(spark: SparkSession, root: str) -> DataFrame:
    """One row per linked record with the smallest key of its entity."""
    return name_links.linked_names(_partners(spark, root)).select(F.col("key").alias("schluessel"), F.col("entity").alias("entity_id"))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return bpe.encode_texts(table(spark, root, "documents"), "doc_id", "text", f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    found = leakage.leaked(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_item"), "item_id", "item_text")
    return found.select("doc_id", "item_id")


def p9_near(spark: SparkSession, root: str) -> DataFrame:
    """Also windows that differ from the item's by up to two words; a window at two edits is found with 0.99 (tested at 0.97)."""
    return leakage.leaked(table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_item"), "item_id", "item_text", max_edits=2, sampled=8, repetitions=28)


def p9_report(spark: SparkSession, root: str) -> DataFrame:
    """How many documents hold each item."""
    return p9_found(spark, root).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return shared_spans.sharing_pairs(table(spark, root, "documents"), "doc_id", "text").select(F.col("doc_a").alias("doc_id_a"), F.col("doc_b").alias("doc_id_b"))


def p10_classes(spark: SparkSession, root: str) -> DataFrame:
    """The same links unexpanded: one row per set of documents that share a passage, and document, with the set's size."""
    found = shared_spans.sharing_classes(table(spark, root, "documents"), "doc_id", "text")
    named = found.groupBy("w1", "w2").agg(F.min("doc").alias("first_doc_id"), F.count(F.lit(1)).alias("n_documents"))
    return found.join(named, ["w1", "w2"]).select(F.concat(F.hex("w1"), F.hex("w2")).alias("class_id"), "first_doc_id", "n_documents", F.col("doc").alias("doc_id"))


def p10_share(spark: SparkSession, root: str) -> DataFrame:
    return shared_spans.shared_share(table(spark, root, "documents"), "doc_id", "text").withColumnRenamed("doc", "doc_id")


_P9 = """WITH folded AS (SELECT doc_id AS id, true AS doc, regexp_extract_all(replace(replace(replace(replace(lower(text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[a-z0-9]+') AS w FROM documents WHERE text <> ''
  UNION ALL SELECT item_id, false, regexp_extract_all(replace(replace(replace(replace(lower(item_text), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), '[a-z0-9]+') FROM eval_item WHERE item_text <> ''),
grams AS (SELECT id, doc, array_to_string(w[i:i + 11], ' ') AS g FROM (SELECT id, doc, w, unnest(generate_series(1, len(w) - 11)) AS i FROM folded WHERE len(w) >= 12)),
found AS (SELECT DISTINCT d.id AS doc_id, i.id::INT AS item_id FROM grams d JOIN grams i ON d.g = i.g AND d.doc AND NOT i.doc)
"""
_P10 = """WITH w AS (SELECT DISTINCT doc_id, md5(substr(text, i::INT, 300)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 299)) AS i FROM documents WHERE length(text) >= 300)),
s AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id WHERE a.h IN (SELECT h FROM s)"""

_P1 = """WITH RECURSIVE n AS (SELECT trim(left_schluessel, ' ') AS a, trim(right_schluessel, ' ') AS b FROM match_pairs),
p AS (SELECT CASE WHEN regexp_full_match(a, '[0-9]+') THEN repeat('0', greatest(18 - length(a), 0)::INT) || a ELSE a END AS a, CASE WHEN regexp_full_match(b, '[0-9]+') THEN repeat('0', greatest(18 - length(b), 0)::INT) || b ELSE b END AS b FROM n WHERE a <> '' AND b <> ''),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(k, l) AS (SELECT a, a FROM e UNION SELECT e.b, r.l FROM r JOIN e ON e.a = r.k AND r.l < e.b)
SELECT min(l) AS cluster_id, k AS schluessel FROM (SELECT k, l FROM r UNION ALL SELECT a, a FROM e) GROUP BY k"""
_P10_SHARE = """WITH w AS (SELECT doc_id, i, md5(substr(text, i::INT, 300)) AS h FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 299)) AS i FROM documents WHERE length(text) >= 300)),
s AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
c AS (SELECT doc_id, sum(least(coalesce(nxt - i, 300), 300))::BIGINT AS shared_chars FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM w WHERE h IN (SELECT h FROM s)) GROUP BY 1)
SELECT doc_id, length(text)::INT AS n_chars, shared_chars, round(shared_chars / length(text), 6) AS share FROM c JOIN documents USING (doc_id)"""

#: The other queries (learned vocabularies, name similarity, encoding, edit distances) have no SQL; they are tested against brute force.
SQL: dict[str, str] = {
    "p9_found": _P9 + "SELECT doc_id, item_id FROM found",
    "p9_report": _P9 + "SELECT item_id, count(*)::BIGINT AS n_documents FROM found GROUP BY 1",
    "p10_found": _P10,
    "p10_share": _P10_SHARE,
    "p1_found": _P1,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit()}

"""Queries and oracle SQL of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, exact_dedup, fill_in_middle, language_id, license_scan, near_dedup, pii, quality_classifier, quality_rules, spelling, suffix_dedup, url_filter
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, rules, keep=["doc_id"])


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages of 50 words or more that other documents hold too."""
    found = suffix_dedup.passages(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_repeated", spans.alias("spans"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan(table(spark, sf_dir, "documents")))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontam.digest(found)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def _bucket(n: int):
    """crc32 of the id as text, mod n: the folds of the learned queries."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels").where(_bucket(5) != 0))
    scored = quality_classifier.score(docs, model)
    return scored.select("doc_id", (_bucket(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(_bucket(4) != 2))
    found = language_id.identify(docs, model, with_runs=False)
    return found.select("doc_id", (_bucket(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"))


def planted_slip(id_: Column, word: Column) -> Column:
    """The contract's slips: of each 31st place by hash, one letter is left out. Without an id there is none."""
    h = F.crc32(F.concat(id_.cast("string"), F.lit(":"), word))
    return F.when(h % 31 == 0, spelling.without_letter(word, (h % F.length(word)).cast("int"))).otherwise(word)


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.words(table(spark, sf_dir, "documents"), change=planted_slip))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digest(fill_in_middle.transform(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_bpe": op2_bpe,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_license_scan": op4_license_scan,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_pii": op7_pii,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_language_id": op9_language_id,
    "op10_near_dedup": op10_near_dedup,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: All windows of 50 words of all documents, and those that two documents hold.
_OP3 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS x FROM i),
r AS (SELECT x FROM x GROUP BY x HAVING count(DISTINCT doc_id) > 1),
p AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM (SELECT DISTINCT doc_id, i FROM x SEMI JOIN r USING (x))),
g AS (SELECT doc_id, i, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM p),
s AS (SELECT doc_id, min(i) - 1 AS a, max(i) + 49 AS b FROM g GROUP BY doc_id, g)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(sum(b - a) AS BIGINT) AS n_repeated, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM s JOIN d USING (doc_id) GROUP BY doc_id, len(w)"""

#: All windows of all items against all windows of the same lengths of all documents.
_OP5 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
v AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x FROM v),
e AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win)),
h AS (SELECT doc_id, i, e.n, item_id FROM e JOIN win ON win.n = e.n AND win.x = array_to_string(w[i:i + e.n - 1], ' ')),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)"""

#: Every place's word by CRC-32 (its table is made by the rule of eight shifts), all pairs by keys, and forms followed to their ends.
_OP12 = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS w FROM documents),
l AS (SELECT doc_id, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM r WHERE length(w) >= 7),
b AS (SELECT w, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, CAST(length(hex(encode(doc_id || ':' || w))) // 2 AS BIGINT) + 1), lambda i: ('0x' || substr(hex(encode(doc_id || ':' || w)), 2 * i - 1, 2))::BIGINT)),
  lambda c, x: xor(c >> 8, crc.t[CAST(xor(c % 256, x) AS BIGINT) + 1])), 4294967295) AS h FROM l, crc),
c AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word FROM b),
v AS (SELECT word, count(*) AS n FROM c WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
k AS (SELECT DISTINCT word, n, unnest(list_concat([word], list_transform(range(length(word)), lambda i: substr(word, 1, i) || substr(word, i + 2)))) AS k FROM v),
p AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.k = b.k AND a.word <> b.word
  WHERE a.k IN (a.word, b.word) OR len(list_filter(range(1, length(a.word) + 1), lambda i: a.word[i] <> b.word[i])) = 1),
g AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM p GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n FROM v LEFT JOIN g USING (word)),
s AS (SELECT word, word AS at, form AS next FROM f UNION ALL SELECT s.word, f.word, f.form FROM s JOIN f ON f.word = s.next)
SELECT f.word, f.form, s.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM f JOIN s ON s.word = f.word AND s.next IS NULL"""

ORACLES: dict[str, str] = {
    "op3_suffix_dedup": _OP3,
    "op4_license_scan": license_scan.oracle(),
    "op5_decontamination": _OP5,
    "op11_exact_dedup": exact_dedup.ORACLE,
    "op12_spelling_variants": _OP12,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}

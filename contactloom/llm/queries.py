"""Registered queries of this subpackage, each over the whole of its table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from contactloom.llm.bpe import bpe_round_trip
from contactloom.llm.chat import format_conversations, loss_text, read_turns
from contactloom.llm.compression import compression_rules
from contactloom.llm.decontaminate import flagged
from contactloom.llm.divergence import divergence_audit
from contactloom.llm.lexical_search import ranked_search
from contactloom.llm.near_dedup import near_duplicates
from contactloom.llm.pitman_yor import lm_scores
from contactloom.llm.quality_model import quality_scores
from contactloom.llm.secret_forest import scan_secrets
from contactloom.llm.substring_dedup import remove_repeats
from contactloom.llm.token_files import Packing, bits_for, read_token_files, write_token_files
from contactloom.llm.toxicity import toxicity_scores
from contactloom.llm.words import documents, held_out
from contactloom.operators.shared import shared_folder

VOCABULARY, VOCABULARY_SIZE, END_ID = "word_bpe_49k.json", 49_408, 1

QUERIES, ORACLES = {}, {}


def register(query):
    QUERIES[query.__name__] = query
    return query


@register
def op1_substring_dedup(spark, sf_dir):
    kept = remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register
def op10_compression_bands(spark, sf_dir):
    return compression_rules(documents(spark, sf_dir))


@register
def op4_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


@register
def op5_bpe_segment_tree(spark, sf_dir):
    done = bpe_round_trip(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


@register
def op3_packed_token_files(spark, sf_dir):
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    manifest = write_token_files(
        documents(spark, sf_dir), folder, public_tokenizers.path(VOCABULARY), Packing(bits_for(VOCABULARY_SIZE)), END_ID
    )
    return read_token_files(manifest).select(
        "doc_id", "start", F.expr("CAST(length(ids) / 4 AS LONG)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@register
def op7_quality_additive_model(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(documents(spark, sf_dir), labels)


PROBE = "</s>[INST] ok [/INST]"


@register
def op9_chat_template(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.sql("VALUES (-7L, 0L, 'user', :text), (-7L, 1L, 'assistant', :text)", args={"text": PROBE})
    rows = rows.union(probe)
    done = format_conversations(rows).withColumn("turns", read_turns(F.col("formatted")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    done = done.withColumn("loss", loss_text(F.col("segments")))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op9_chat_template"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, length(replace(text, '\', '\\')) + (length(regexp_replace(text, '<s>|\[AS\]|<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|\[OUT\]|</s>|\[TURN\]|\[/TURN\]', '\0#', 'g')) - length(text)) AS body,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 9 ELSE 17 + length(role) END AS marks
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(body + marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@register
def op2_toxicity_noisy_channel(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_scores(documents(spark, sf_dir), labels)


@register
def op6_template_decontamination(spark, sf_dir):
    return flagged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@register
def op8_secret_forest(spark, sf_dir):
    found = scan_secrets(documents(spark, sf_dir))
    return found.select(
        "doc_id", "nth", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret"
    )


@register
def op11_pitman_yor_lm(spark, sf_dir):
    docs = documents(spark, sf_dir)
    scored = lm_scores(docs, ~held_out("doc_id", 10, 0))
    return scored.select("doc_id", held_out("doc_id", 10, 0).alias("held_out"), *[c for c in scored.columns if c != "doc_id"])


@register
def op12_length_strata_search(spark, sf_dir):
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op12_length_strata_search"] = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE doc_id IS NOT NULL
), s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS nd, sum(len(t)) AS tot FROM d),
u AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM u GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT nd FROM s) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM p GROUP BY term),
q AS (SELECT item_id, unnest(regexp_extract_all({ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
qc AS (SELECT item_id, term, count(*) AS qtf FROM q GROUP BY ALL),
sc AS (
  SELECT qc.item_id, p.doc_id,
    sum(qc.qtf * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * (75 + (25 * p.n * s.nd) // s.tot)))) AS score
  FROM qc JOIN p USING (term) JOIN w USING (term) CROSS JOIN s GROUP BY ALL
)
SELECT CAST(item_id AS BIGINT) AS item_id, CAST(rank AS INTEGER) AS rank, CAST(doc_id AS BIGINT) AS doc_id, CAST(score AS BIGINT) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
WHERE rank <= 20
"""


@register
def op13_iceberg_divergence(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return divergence_audit(docs)


ORACLES["op13_iceberg_divergence"] = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all({ASCII_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
), g AS (SELECT DISTINCT lang, source FROM d),
tok AS (SELECT doc_id, lang, source, unnest(t) AS term FROM d),
kv AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30),
nv AS (SELECT l.lang, count(kv.term) AS v FROM (SELECT DISTINCT lang FROM g) l LEFT JOIN kv USING (lang) GROUP BY l.lang),
c AS (SELECT lang, source, term, count(*) AS cnt FROM tok JOIN kv USING (lang, term) GROUP BY ALL),
cl AS (SELECT lang, term, sum(cnt) AS cnt FROM c GROUP BY ALL),
ng AS (SELECT g.lang, g.source, coalesce(sum(c.cnt), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
nl AS (SELECT lang, coalesce(sum(cnt), 0) AS n FROM cl GROUP BY lang),
pg AS (
  SELECT g.lang, g.source, kv.term, coalesce(c.cnt, 0) AS cnt,
    1 + (1000000000::HUGEINT * (coalesce(c.cnt, 0) + 5)) // (ng.n + 5 * nv.v) AS p
  FROM g JOIN kv USING (lang) JOIN ng USING (lang, source) JOIN nv USING (lang)
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kv.term
),
pl AS (
  SELECT kv.lang, kv.term, 1 + (1000000000::HUGEINT * (coalesce(cl.cnt, 0) + 5)) // (nl.n + 5 * nv.v) AS q
  FROM kv JOIN nl USING (lang) JOIN nv USING (lang) LEFT JOIN cl ON cl.lang = kv.lang AND cl.term = kv.term
),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pg x ON x.lang = a.lang AND x.source = a.source
  LEFT JOIN pg y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
  GROUP BY ALL
),
term AS (
  SELECT x.lang, x.source, 'term' AS part, x.term AS item, x.p - l.q AS value
  FROM pg x JOIN pl l ON l.lang = x.lang AND l.term = x.term WHERE x.cnt > 0 AND x.p > l.q
),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""

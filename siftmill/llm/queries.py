"""The registered queries of this package: thin digests of its operators."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmill.llm import byte_bpe, chat, exact, html_extract, langid, license_scan, merkle, packing, quality, simhash, spelling, token_count, word_bpe


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("tokens").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~langid.held_out()))
    predict = langid.predictor(spark, model)
    found = docs.select("doc_id", langid.held_out().alias("held_out"), predict(F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("digest", "text_sha256")


# lower() of DuckDB knows all of Unicode; translate() changes A-Z only
OP4_SQL = """
WITH rows AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM rows WINDOW same AS (PARTITION BY norm)
"""


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_pages(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumn("differences", F.array_join("differences", " "))


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = word_bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "\\### Assistant: </turn> ok"  # the conversation that the contract adds
    added = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], turns.schema)
    return chat.read_back(chat.format_conversations(turns.unionByName(added)))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    breaks = F.translate("text", "\n", "")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, breaks).otherwise(F.col("text"))
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered=tampered)
    proof = F.sha2(merkle.proof_text(F.col("path")), 256).alias("proof_sha256")
    return found.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", "verified")


# CRC-32 of the bytes in column {bytes}, a list of numbers, with the table of its 256 steps in ``crc``
CRC_TABLE = """crc AS (
  SELECT list(step ORDER BY i) AS steps FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS step FROM range(256) AS r(i)
  )
)"""


def crc32_sql(numbers: str) -> str:
    return f"xor(list_reduce([4294967295::BIGINT] || {numbers}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
given AS (
  SELECT doc_id, source, text,
         concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
         CASE WHEN {crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)")} % 2 = 0
              THEN replace(text, chr(10), '') ELSE text END AS changed
  FROM documents, crc
),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS changed,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n
  FROM given
),
nodes AS (
  SELECT source, 0 AS level, idx, n, leaf AS node FROM leaves
  UNION ALL
  SELECT source, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY idx))
  FROM nodes WHERE n > 1 GROUP BY source, level, n, idx // 3
),
runs AS (SELECT source, level, idx // 3 AS run, list(node ORDER BY idx) AS members FROM nodes WHERE n > 1 GROUP BY ALL),
folds AS (
  SELECT doc_id, source, 0 AS level, idx, changed AS node, '' AS proof FROM leaves
  UNION ALL
  SELECT doc_id, f.source, f.level + 1, run,
         sha256(array_to_string(members[1:idx % 3], '') || f.node || array_to_string(members[idx % 3 + 2:], '')),
         proof || array_to_string(members[1:idx % 3], '') || array_to_string(members[idx % 3 + 2:], '')
  FROM folds f JOIN runs r ON f.source IS NOT DISTINCT FROM r.source AND f.level = r.level AND f.idx // 3 = r.run
),
folded AS (SELECT * FROM folds QUALIFY level = max(level) OVER (PARTITION BY doc_id)),
subroots AS (
  SELECT source, node AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
),
upper AS (
  SELECT 0 AS level, idx, n, subroot AS node FROM subroots
  UNION ALL
  SELECT level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY level, n, idx // 3
),
upper_runs AS (SELECT level, idx // 3 AS run, list(node ORDER BY idx) AS members FROM upper WHERE n > 1 GROUP BY ALL),
climbs AS (
  SELECT doc_id, subroot, 0 AS level, s.idx, node, proof FROM folded f JOIN subroots s ON f.source IS NOT DISTINCT FROM s.source
  UNION ALL
  SELECT doc_id, subroot, c.level + 1, run,
         sha256(array_to_string(members[1:idx % 3], '') || node || array_to_string(members[idx % 3 + 2:], '')),
         proof || array_to_string(members[1:idx % 3], '') || array_to_string(members[idx % 3 + 2:], '')
  FROM climbs c JOIN upper_runs r ON c.level = r.level AND c.idx // 3 = r.run
),
climbed AS (SELECT * FROM climbs QUALIFY level = max(level) OVER (PARTITION BY doc_id))
SELECT doc_id, leaf, subroot, u.node AS root, sha256(proof) AS proof_sha256, c.node AS folded_root, c.node = u.node AS verified
FROM climbed c JOIN leaves USING (doc_id) JOIN upper u ON u.n = 1
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), drop_every=97)
    return spelling.spelling_variants(words)


OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
  ) GROUP BY ALL
),
octets AS (
  SELECT doc_id, run, times, list_transform(regexp_extract_all(hex(encode(doc_id || ':' || run)), '..'),
    lambda x: (instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1) AS numbers FROM runs
),
hashed AS (SELECT run, times, {crc32_sql("numbers")} AS h FROM octets, crc),
written AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed
),
words AS (SELECT word, sum(times)::BIGINT AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, k - 1) || substr(word, k + 1) AS other FROM places),
holes AS (SELECT word, n, substr(word, 1, k - 1) || '*' || substr(word, k + 1) AS hole FROM places),
near AS (
  SELECT s.word, w.word AS near, w.n AS near_n FROM shorter s JOIN words w ON s.other = w.word
  UNION ALL SELECT w.word, s.word, s.n FROM shorter s JOIN words w ON s.other = w.word
  UNION ALL SELECT a.word, b.word, b.n FROM holes a JOIN holes b USING (hole) WHERE a.word <> b.word
),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM near GROUP BY word
),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n
  FROM words LEFT JOIN best USING (word)
),
paths AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL SELECT p.word, f.form, steps + 1 FROM paths p JOIN forms f ON p.root = f.word WHERE f.form IS NOT NULL
),
roots AS (SELECT word, last(root ORDER BY steps) AS root FROM paths GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens", F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_packing": (op1_packing, None),
    "op2_language_id": (op2_language_id, None),
    "op3_quality_rules": (op3_quality_rules, None),
    "op4_exact_dedup": (op4_exact_dedup, OP4_SQL),
    "op5_html_extraction": (op5_html_extraction, None),
    "op6_license_scan": (op6_license_scan, None),
    "op7_word_bpe": (op7_word_bpe, None),
    "op8_token_count": (op8_token_count, None),
    "op9_chat_format": (op9_chat_format, None),
    "op10_simhash": (op10_simhash, None),
    "op11_merkle": (op11_merkle, OP11_SQL),
    "op12_spelling": (op12_spelling, OP12_SQL),
    "op13_byte_bpe": (op13_byte_bpe, None),
}

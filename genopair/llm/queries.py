"""The operators as registered queries over whole tables, with production parameters."""

from pyspark.sql import functions as F

from genopair.llm import alignment, ann, bpe, chat, embedding_dedup, hard_negatives, html_text, line_dedup, minhash, packing, quality, suffix, toxicity
from genopair.llm.common import table

QUERIES, ORACLE = {}, {}

BYTE_BPE, WORD_BPE, PIECE_BPE = "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), BYTE_BPE)


@query
def op2_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_minhash(spark, sf_dir):
    found = minhash.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@query
def op5_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op6_chat(spark, sf_dir):
    says = "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(says))
    formatted = chat.format_paths(chat.paths(chat.chains(turns)))
    return chat.read_back(formatted).withColumnRenamed("tree_id", "conv_id")


@query
def op7_ann(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op8_line_dedup(spark, sf_dir):
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# --- the same rows in DuckDB ----------------------------------------------------------------------

ORACLE["op8_line_dedup"] = line_dedup.SQL

REACHED = """
reached AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, l.y FROM reached r JOIN links l ON r.other = l.x),
smallest AS (SELECT id, min(other) AS class_id FROM reached GROUP BY id)"""

ORACLE["op4_minhash"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), bags AS (SELECT doc_id, s, count(*) AS c FROM shingles GROUP BY ALL
), sizes AS (SELECT doc_id, sum(c) AS n FROM bags GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.c, b.c)) AS o FROM bags a JOIN bags b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE o >= 0.8::DOUBLE * (p.n + q.n - o)
), nodes AS (SELECT doc_id AS id FROM documents),
{REACHED}
SELECT id AS doc_id, class_id, id = class_id AS kept FROM smallest
"""

ORACLE["op5_embedding_dedup"] = f"""
WITH RECURSIVE vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), nodes AS (SELECT vec_id AS id FROM vectors),
{REACHED}, degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, class_id AS component_id, id = class_id AS kept FROM smallest LEFT JOIN degrees ON x = id
"""

ORACLE["op6_chat"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\<>\[\]]', '', 'g')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 5
    ELSE 11 + length(role) + length(regexp_replace(role, '[^\\<>\[\]]', '', 'g')) END AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query
def op9_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "text")


@query
def op10_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


@query
def op11_hard_negatives(spark, sf_dir):
    id_, label = F.col("vec_id"), F.col("label")
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), id_ % 100 == 0, F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label))


ORACLE["op11_hard_negatives"] = hard_negatives.SQL


@query
def op12_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op13_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)

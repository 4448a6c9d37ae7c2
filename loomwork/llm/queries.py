"""One query for each operator, over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, chat, fingerprint, importance, katz, language, minhash, mixing, secrets, substrings, topk, trie, warc
from loomwork.llm.shared import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(table(spark, sf_dir, "documents"))


def op2_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    prototypes = language.learn(docs.filter(~language.held_out()))
    found = language.predict(docs.withColumn("held_out", language.held_out()), prototypes, carried=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(topk.usable(F.col("embedding"))).select("vec_id", topk.floored(F.col("embedding")).alias("embedding"))
    found = topk.top_k(rows, F.col("vec_id") % 50 == 0, 5)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP4_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), stable=True)


OP5_SQL = """
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
f AS (
  SELECT page_id, octet_length(b) AS n, sha1(b) AS h, min(page_id) OVER (PARTITION BY sha1(b)) AS first_id FROM d
), t AS (
  -- five hex digits are four base32 letters
  SELECT *, array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform([32768, 1024, 32, 1], lambda unit:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST('0x' || substr(h, CAST(g * 5 + 1 AS INTEGER), 5) AS BIGINT) // unit % 32 + 1 AS INTEGER), 1)), '')), '') AS digest FROM f
)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM t
"""


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    digests = lambda done: done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"), stable=True, finish=digests)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "shards")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, id + 1 AS turn, if(id = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2)")
    records = rows.unionByName(extra).withColumn("text", F.coalesce("text", F.lit("")))
    # conversations come in three layouts, which the fingerprint has to tell apart; roles stay as they are
    one, two = F.struct("role", F.col("text").alias("content")), F.struct(F.col("role").alias("from"), F.col("text").alias("value"))
    layout = F.pmod("conv_id", F.lit(3))
    record = F.when(layout == 0, F.to_variant_object(F.struct(F.array(one).alias("messages"), F.col("turn").alias("id")))).when(layout == 1, F.to_variant_object(F.struct(F.array(two).alias("conversations")))).otherwise(F.to_variant_object(F.struct("role", "text")))
    turned = chat.canonical_turns(records, record, roles={})
    made = chat.format_turns(chat.gather(turned)).select("conv_id", "formatted", "loss_spans")
    back = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 1, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 2, 'assistant', '</s>[INST] ok [/INST]'
), e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\2\\\3', 'g') AS esc FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(esc) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80, stable=True)


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.ordered_turns(table(spark, sf_dir, "conversations"))
    conv = F.col("conv")
    turns, lengths = trie.with_shared_heads(turns, conv - conv % 20, (F.crc32(conv.cast("string")) % 4).cast("int"), 3)
    return trie.prefix_trie(turns, lengths)


#: CRC-32 of bytes, over a table of 256 remainders made by its rule: a table t(t) and the value of a hex string.
CRC_TABLE = "SELECT list_transform(range(0, 256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t"
CRC_OF = "xor(list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: CAST('0x' || x AS BIGINT))), lambda c, x: xor(t[xor(c % 256, x) + 1], c // 256)), 4294967295)"

OP11_SQL = f"""
WITH t AS ({CRC_TABLE}),
o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), h AS (SELECT c, CAST({CRC_OF.format("CAST(c AS VARCHAR)")} % 4 AS BIGINT) AS h FROM (SELECT DISTINCT c FROM o), t),
r AS (
  SELECT h.c, o.pos, o.role, o.text FROM h JOIN o ON o.c = h.c - h.c % 20 AND o.pos <= h.h
  UNION ALL
  SELECT h.c, o.pos - h.h + (SELECT count(*) FROM o b WHERE b.c = h.c - h.c % 20 AND b.pos <= h.h), o.role, o.text FROM h JOIN o ON o.c = h.c AND o.pos > h.h
), s AS (
  SELECT c, pos, length(list_filter(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), lambda w: w <> '')) AS words,
    string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY pos) AS id,
    string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up
  FROM r UNION ALL SELECT c, 0, 0, '', NULL FROM h
), p AS (SELECT c, pos, words, sha256(id) AS id, CASE WHEN pos > 0 THEN sha256(coalesce(up, '')) END AS up, pos = max(pos) OVER (PARTITION BY c) AS ends FROM s),
n AS (
  SELECT id, any_value(up) AS up, any_value(pos) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saves,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY id
), k AS (SELECT n.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.up = n.id) AS n_children FROM n LEFT JOIN n u ON u.id = n.up),
below AS (SELECT DISTINCT a.id, b.id AS low FROM p a JOIN p b ON a.c = b.c AND b.pos >= a.pos),
sums AS (SELECT below.id, count(*) FILTER (k.n_children = 0) AS n_leaves, CAST(sum(k.saves) AS BIGINT) AS saved_tokens FROM below JOIN k ON k.id = below.low GROUP BY below.id)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM k JOIN sums USING (id)
"""


def op12_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5
    found = katz.score(table(spark, sf_dir, "documents"), fifth != 1)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = f"""
WITH t AS ({CRC_TABLE}),
a AS (SELECT doc_id, NULL AS item_id, text FROM documents UNION ALL SELECT NULL, item_id, text FROM benchmark),
r AS (SELECT row_number() OVER () AS row, doc_id, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM a),
u AS (SELECT row, doc_id, item_id, unnest(w) AS w FROM r),
b AS (SELECT w, CAST({CRC_OF.format("w")} % 10000 AS BIGINT) AS bucket FROM (SELECT DISTINCT w FROM u), t),
f AS (SELECT row, item_id, bucket FROM u JOIN b USING (w)),
c AS (SELECT bucket, count(*) FILTER (item_id IS NULL) AS s, count(item_id) AS t FROM f GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE) / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM c),
w AS (SELECT row, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM f JOIN g USING (bucket) GROUP BY row),
d AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM r LEFT JOIN w USING (row) WHERE item_id IS NULL
), k AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM k
"""


QUERIES = {"op1_bpe": op1_bpe, "op2_fingerprint": op2_fingerprint, "op3_language": op3_language, "op4_topk": op4_topk, "op5_warc": op5_warc, "op6_substrings": op6_substrings, "op7_mixing": op7_mixing, "op8_secrets": op8_secrets, "op9_chat": op9_chat, "op10_minhash": op10_minhash, "op11_trie": op11_trie, "op12_katz": op12_katz, "op13_importance": op13_importance}
ORACLES: dict[str, str] = {"op4_topk": OP4_SQL, "op5_warc": OP5_SQL, "op9_chat": OP9_SQL, "op11_trie": OP11_SQL, "op13_importance": OP13_SQL}

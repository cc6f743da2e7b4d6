"""The registered queries of the corpus operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braidlog.llm.common import read


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.fingerprint import fingerprint_documents

    return fingerprint_documents(read(spark, sf_dir, "documents"))


#: A score from which a document is taken to carry the label.
THRESHOLD = 0.7


def fold(doc_id, folds: int):
    """crc32 of the id as text, modulo folds."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def toxicity_network(spark: SparkSession, docs: DataFrame, sf_dir: str):
    from braidlog.llm.toxicity import Training, labelled_sample, train, trained

    rows, prior = labelled_sample(docs, read(spark, sf_dir, "labels"), "toxic", lambda i: fold(i, 3) != 1, Training().sample)
    return trained(rows, lambda texts, labels: train(texts, labels, prior))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.toxicity import score_documents

    docs = read(spark, sf_dir, "documents")
    scored = score_documents(docs, toxicity_network(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op3_packing_of(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    from braidlog.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_packing_of(read(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.dedup import exact_groups, normalised

    docs = read(spark, sf_dir, "documents").withColumn("text_sha256", F.sha2(normalised(F.col("text")), 256))
    return exact_groups(docs, carry=("text_sha256",)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept, text_sha256
FROM t
"""


def op5_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.sharding import assign_shards

    docs = read(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = {"size": (F.octet_length(text) + 16).cast("long"), "text_crc32": F.crc32(text), "law": F.lit("key")}
    return assign_shards(docs, "doc_id", (1.0,) * 40, keep).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.jaccard import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


def quality_network(spark: SparkSession, docs: DataFrame, sf_dir: str):
    from braidlog.llm.quality import Training, train
    from braidlog.llm.toxicity import labelled_sample, trained

    rows, prior = labelled_sample(docs, read(spark, sf_dir, "labels"), "quality", lambda i: fold(i, 4) != 2, Training().sample)
    return trained(rows, lambda texts, labels: train(texts, labels, prior))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.quality import score_documents

    docs = read(spark, sf_dir, "documents")
    scored = score_documents(docs, quality_network(spark, docs, sf_dir))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.chat import format_conversations, parse_conversations

    said = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = parse_conversations(format_conversations(turns))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    said_all = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.withColumn("__loss", loss).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said_all, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2("__loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)
), marked AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) <> role, true) AS opens,
    role || text AS inside
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(text) + length(text) - length(replace(replace(text, '\', ''), '<', ''))
    + CASE WHEN opens THEN 19 + length(role) + length(role) - length(replace(replace(role, '\', ''), '<', '')) ELSE 5 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""

#: Words of host names that mark junk; their URLs are label 1 beside those of the table of labels, which says nothing of URLs here.
JUNK_WORDS = ("ads", "adult", "bets", "casino", "pills", "spam")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.urlrules import HostRule, judge_urls, labelled_urls, mine_rules

    pages, labels = read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")
    # A page to block: its label says low quality or toxic, or its host has a word of hosts that are junk anywhere.
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    mined = mine_rules(labelled_urls(pages, labels, bad, junk=JUNK_WORDS))
    fixed = [HostRule("com", "/", "allow"), HostRule("example.com", "/en/", "block"), HostRule("www.example.com", "/en/", "allow"), HostRule("net", "/es/", "block"), HostRule("net", "/fr/", "block")]
    return judge_urls(pages, fixed, mined)


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from braidlog.llm.bpe import decode_documents, encode_documents

    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    encoded = encode_documents(read(spark, sf_dir, "documents"), tokenizer).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode_documents(encoded, tokenizer).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from braidlog.llm.exchange import pack_by_exchange

    return pack_by_exchange(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op12_dual_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.dualtree import cluster_vectors

    return cluster_vectors(read(spark, sf_dir, "embeddings"))


def _lloyd_sql(rounds: int = 10) -> str:
    """Rounds written out: c0, c1, ... hold a row for each centroid and component."""
    nearest = "SELECT vec_id, no, arg_min(c, (d, c)) AS cluster, min(d) AS distance FROM (SELECT q.no, any_value(q.vec_id) AS vec_id, c.c, sum((q.x - c.x) * (q.x - c.x))::BIGINT AS d FROM q JOIN {c} c USING (dim) GROUP BY q.no, c.c) GROUP BY vec_id, no"
    ctes = []
    for k in range(1, rounds + 1):
        ctes.append(f"a{k} AS MATERIALIZED ({nearest.format(c=f'c{k - 1}')})")
        mean = f"SELECT cluster AS c, dim, (s - ((s % n) + n) % n) // n AS x FROM (SELECT cluster, dim, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM q JOIN a{k} USING (no) GROUP BY 1, 2)"
        ctes.append(f"c{k} AS MATERIALIZED (SELECT o.c, o.dim, coalesce(m.x, o.x)::BIGINT AS x FROM c{k - 1} o LEFT JOIN ({mean}) m USING (c, dim))")
    last = f"c{rounds}"
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, embedding, row_number() OVER () AS no FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
q AS MATERIALIZED (SELECT no, vec_id, unnest(range(64)) AS dim, floor(1024 * unnest(embedding)::DOUBLE)::BIGINT AS x FROM v),
first AS (SELECT no, row_number() OVER (ORDER BY sha256('3:' || vec_id), embedding) - 1 AS c FROM v QUALIFY c < 8),
c0 AS MATERIALIZED (SELECT c::INTEGER AS c, dim, x FROM q JOIN first USING (no)),
{", ".join(ctes)},
a AS ({nearest.format(c=last)}), h AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM {last} GROUP BY c)
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256 FROM a JOIN h ON c = cluster
"""


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from braidlog.llm.trie import conversation_trie

    return conversation_trie(read(spark, sf_dir, "conversations"))


#: DuckDB has no crc32, so its table of bytes is made from the polynomial and applied to the digits of a number.
OP13_SQL = r"""
WITH RECURSIVE poly(b, k, v) AS (SELECT b, 0, b::BIGINT FROM range(256) r(b) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM poly WHERE k < 8),
bytes AS (SELECT list(v ORDER BY b) AS t FROM poly WHERE k = 8),
crc(c, pos, v) AS (SELECT DISTINCT conv_id, 0, 4294967295::BIGINT FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT c, pos + 1, xor(v >> 8, t[xor(v & 255, ascii(substr(c::VARCHAR, pos + 1, 1))) + 1]) FROM crc, bytes WHERE pos < length(c::VARCHAR)),
heads AS (SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE pos = length(c::VARCHAR)),
o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT h.c, o.p, role, text, 0 AS own FROM heads h JOIN o ON o.c = h.c - h.c % 20 AND o.p <= h.h UNION ALL SELECT h.c, o.p, role, text, 1 FROM heads h JOIN o ON o.c = h.c AND o.p > h.h),
d AS (SELECT c, role, text, row_number() OVER (PARTITION BY c ORDER BY own, p) AS depth FROM r),
m AS MATERIALIZED (SELECT c, depth, text, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY c ORDER BY depth)) AS k FROM d UNION ALL SELECT c, 0, '', '' FROM heads),
n AS MATERIALIZED (SELECT k, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> ''))) AS saved FROM m GROUP BY k, depth),
up AS MATERIALIZED (SELECT DISTINCT a.k, b.k AS parent FROM m a JOIN m b ON a.c = b.c AND b.depth = a.depth - 1),
kids AS (SELECT parent AS k, count(*) AS n_children FROM up GROUP BY parent),
sub AS (SELECT DISTINCT a.k, b.k AS below FROM m a JOIN m b ON a.c = b.c AND b.depth >= a.depth),
sums AS (SELECT sub.k, sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (kids.k IS NULL) AS n_leaves FROM sub JOIN n ON n.k = sub.below LEFT JOIN kids ON kids.k = sub.below GROUP BY sub.k),
ends AS (SELECT k, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM m WHERE depth = (SELECT max(depth) FROM m x WHERE x.c = m.c) GROUP BY k)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM n JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN up USING (k) LEFT JOIN n p ON p.k = up.parent LEFT JOIN ends ON ends.k = n.k
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_rendezvous_shards": op5_rendezvous_shards,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_quality": op7_quality,
    "op8_chat_format": op8_chat_format,
    "op9_url_rules": op9_url_rules,
    "op10_bpe_codec": op10_bpe_codec,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_dual_tree_clusters": op12_dual_tree_clusters,
    "op13_conversation_trie": op13_conversation_trie,
}

ORACLE_SQL: dict[str, str] = {"op4_exact_dedup": OP4_SQL, "op8_chat_format": OP8_SQL, "op12_dual_tree_clusters": _lloyd_sql(), "op13_conversation_trie": OP13_SQL}

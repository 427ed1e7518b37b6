"""One thin query for each operator: its whole table, production parameters, the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, chat, infill, language, minhash, mixing, order_minhash, personal, quality, secrets, substrings, toxicity
from .common import read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(read(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.judge(read(spark, sf_dir, "documents"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), words=4, similarity=(80, 100))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_neighbours(read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


#: Conversation -1: texts that are control strings of common templates.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digest(chat.format_turns(rows))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(read(spark, sf_dir, "embeddings"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(read(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digest(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scan, op2_suffix_array_dedup, op3_toxicity, op4_language_id, op5_minhash_dedup, op6_source_mix, op7_order_minhash, op8_quality_rules, op9_chat_format, op10_byte_bpe, op11_centroid_clusters, op12_fill_in_middle, op13_personal_data)
}

_WORD = r"[^\x20\x09-\x0D]+"

_MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS shuffled FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE nth % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
l AS (
  SELECT *, cap / weight AS lev, sum(cap) OVER u - cap AS cap_before, sum(weight) OVER u - weight AS weight_before,
         sum(weight) OVER () AS all_weight, CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM w WINDOW u AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, (total - cap_before) / (all_weight - weight_before) AS open FROM l),
t AS (
  SELECT source, source_size, CASE WHEN lev <= (SELECT min_by(open, lev) FROM o WHERE open <= lev) THEN cap
         ELSE weight * (SELECT min_by(open, lev) FROM o WHERE open <= lev) END AS target FROM o),
e AS (
  SELECT d.*, t.source_size, t.target, row_number() OVER r AS nth, sum(d.size) OVER r AS ends
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
  WINDOW r AS (PARTITION BY d.source ORDER BY shuffled, d.doc_id NULLS LAST, d.size ROWS UNBOUNDED PRECEDING)),
f AS (
  SELECT e.*, a.again, (ends + a.again * source_size) / target AS finish
  FROM e, (VALUES (0), (1), (2)) a(again) WHERE size > 0 AND target > 0 AND a.again <= ceil(target / source_size)),
g AS (
  SELECT *, sum(size) OVER (ORDER BY finish, shuffled, source NULLS LAST, doc_id NULLS LAST, again, nth ROWS UNBOUNDED PRECEDING) AS upto FROM f),
k AS (SELECT source, nth, count(*) AS copies FROM g WHERE upto <= (SELECT sum(source_size) FROM s) GROUP BY source, nth)
SELECT e.doc_id, e.size, e.source_size, e.target, CAST(e.size * coalesce(k.copies, 0) AS BIGINT) AS taken
FROM e LEFT JOIN k ON e.source IS NOT DISTINCT FROM k.source AND e.nth = k.nth
"""

_CHAT_SQL = r"""
WITH r AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
m AS (
  SELECT *, CASE role WHEN 'user' THEN length('<s>[INST]  [/INST]</s>') WHEN 'assistant' THEN length('<s>[OUT]  [/OUT]</s>')
            ELSE length('<s>[ROLE ]  [/ROLE]</s>') + length(replace(replace(role, '\', '\\'), ']', '\]')) END AS marks,
         len(regexp_extract_all(text, '<s>|<s!>|</s>|\[INST\]|\[/INST\]|\[OUT\]|\[/OUT\]|\[ROLE |\[/ROLE\]')) AS controls FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(marks + length(text) + CASE WHEN controls > 0 THEN 1 + controls + length(text) - length(replace(text, '\', '')) ELSE 0 END) AS BIGINT) AS formatted_chars, true AS identical
FROM m GROUP BY conv_id
"""

_FILL_SQL = r"""
WITH d AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
n AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
k AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""


def _cluster_sql(k: int = centroids.CENTROIDS, rounds: int = centroids.ROUNDS) -> str:
    most = centroids.MOST
    out = f"""
WITH v AS (
  SELECT row_number() OVER () AS id, CAST(vec_id AS BIGINT) AS vec_id,
         list_transform(embedding, lambda x: CAST(greatest(-{most}, least({most}, floor({centroids.SCALE} * CAST(x AS DOUBLE)))) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {centroids.COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {centroids.COMPONENTS}),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS j, v AS c FROM v QUALIFY j < {k})"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS (SELECT id, min_by(j, (d, j)) AS j, min(d) AS d FROM (SELECT id, j, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v, c{r}) GROUP BY id)"""
        if r < rounds:
            out += f""",
s{r} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT j, unnest(v) AS x, unnest(range(1, {centroids.COMPONENTS + 1})) AS i FROM a{r} JOIN v USING (id)) GROUP BY j, i),
c{r + 1} AS (SELECT j, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{r} GROUP BY j) m USING (j))"""
    return out + f"""
SELECT vec_id, CAST(j AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY j) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (id) JOIN c{rounds} USING (j)
"""


#: The others have no SQL: models, whole-text hashing and index structures, tested by brute force in tests/llm.
ORACLE_SQL = {"op6_source_mix": _MIX_SQL, "op9_chat_format": _CHAT_SQL, "op11_centroid_clusters": _cluster_sql(), "op12_fill_in_middle": _FILL_SQL}

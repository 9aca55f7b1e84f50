"""The queries of this package: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelspark.llm import ann, chat, decontaminate, embed_dedup, infill, lm_score, minhash, mixing, packing, quality, sharding, spelling, url_filter
from parcelspark.llm.common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = mixing.taken(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select("row.doc_id", "size", "source_size", "target", "taken")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op6_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_score.cross_entropy_difference(docs, table(spark, sf_dir, "benchmark"), docs)


def op7_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(table(spark, sf_dir, "documents"))


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", F.col("__url_host").alias("host"), F.col("__url_path").alias("path"), F.col("__rule").alias("rule"), F.col("__verdict").alias("verdict"))


def op9_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(~quality.held_out(F.col("doc_id"))))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op10_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(table(spark, sf_dir, "conversations"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.infilled(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_mixing, op3_nearest_neighbours, op4_minhash_forest, op5_embedding_dedup, op6_cross_entropy_difference, op7_extendible_sharding, op8_url_filter, op9_quality_nbsvm, op10_chat_collapse, op11_spelling_variants, op12_decontamination, op13_fill_in_middle)}

ORACLES: dict[str, str] = {
    "op2_mixing": r"""
WITH d AS (SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
    FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT min(level) AS x FROM (SELECT level FROM l WHERE CAST(cap AS DOUBLE) > level * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1)),
t AS (SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), x * weight), CAST(cap AS DOUBLE)) AS target FROM l, x),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(floor(target + 0.5) / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
r AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) - epochs * source_size AS left_words FROM e),
k AS (SELECT source, key, sum(size) AS size, count(*) AS n FROM d GROUP BY source, key),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT d.doc_id, d.size, r.source_size, r.target,
    CAST(r.epochs * d.size + CASE WHEN p.before + p.size <= r.left_words THEN d.size WHEN p.before < r.left_words THEN least(d.size, floor((r.left_words - p.before) / p.n)) ELSE 0 END AS BIGINT) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN p ON d.source IS NOT DISTINCT FROM p.source AND d.key = p.key""",
    "op7_extendible_sharding": """
WITH d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS h FROM documents),
b AS (SELECT *, lpad(bin(h), 48, '0') AS bits FROM d),
e AS (SELECT *, unnest(range(0, 49)) AS depth FROM b),
s AS (SELECT substr(bits, 1, depth) AS shard, depth, sum(n_bytes) AS shard_bytes FROM e GROUP BY 1, 2 HAVING sum(n_bytes) <= 1048576),
f AS (SELECT e.doc_id, e.n_bytes, s.shard, s.depth, s.shard_bytes, row_number() OVER (PARTITION BY e.doc_id ORDER BY s.depth) AS k FROM e JOIN s ON s.depth = e.depth AND s.shard = substr(e.bits, 1, e.depth))
SELECT doc_id, n_bytes, shard, CAST(depth AS INTEGER) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes FROM f WHERE k = 1""",
    "op10_chat_collapse": """
WITH c AS (SELECT conv_id, count(*) AS n, list(CASE WHEN role IS NULL THEN 'n' ELSE 'r' || strlen(role) || ':' || role END || CASE WHEN text IS NULL THEN 'n' ELSE 't' || text END ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said FROM conversations GROUP BY conv_id),
m AS (SELECT said, n, min(conv_id) AS conv_id FROM c GROUP BY said, n),
k AS (SELECT conv_id, n FROM m WHERE NOT EXISTS (SELECT 1 FROM c AS o WHERE o.said[1] = m.said[1] AND o.n > m.n AND o.said[1:m.n] = m.said))
SELECT t.conv_id, turn, role, n AS n_turns, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered FROM conversations AS t JOIN k ON t.conv_id IS NOT DISTINCT FROM k.conv_id""",
    "op11_spelling_variants": r"""
WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
u AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
v AS (SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)) AS x, count(*) AS n FROM u WHERE length(run) >= 7 GROUP BY ALL),
c AS (SELECT run, n, xor(4294967295, list_reduce(list_concat([4294967295], [CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT) FOR k IN range(length(x) // 2)]), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM v, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1 HAVING sum(n) >= 2 AND length(word) >= 7),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM x AS a JOIN x AS b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM x AS a JOIN w AS b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM x AS a JOIN w AS b ON a.less = b.word),
q AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, ROW(-other_n, other)) AS best FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN q USING (word)),
r AS (SELECT word, word AS root FROM f UNION ALL SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON f.word = r.word JOIN f AS e ON e.word = r.root WHERE e.form IS NULL""",
    "op12_decontamination": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
j AS (SELECT item_id, w, least(10, len(w)) AS l, unnest(range(greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, l, array_to_string(w[s + 1:s + l], ' ') AS p FROM j),
e AS (SELECT d.r, d.w, k.l, unnest(range(len(d.w) - k.l + 1)) AS s FROM d, (SELECT DISTINCT l FROM x) AS k WHERE len(d.w) >= k.l),
h AS (SELECT r, s, e.l, item_id FROM (SELECT r, s, l, array_to_string(w[s + 1:s + l], ' ') AS p FROM e) AS e JOIN x ON e.l = x.l AND e.p = x.p),
c AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(s, s + l)) AS pos FROM h) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN n USING (r)""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
e AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * k + 1, 8) AS BIGINT) FOR k IN range(4)] AS h FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b FROM e),
g AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256 FROM g""",
}

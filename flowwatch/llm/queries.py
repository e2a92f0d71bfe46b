"""One query per training-data operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowwatch.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from flowwatch.llm.tokens import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_benchmark_decontamination", """
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS wide, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, k.wide, i, array_to_string(w[i:i + k.wide - 1], ' ') AS win
  FROM (SELECT doc_id, w, wide, unnest(range(1, len(w) - wide + 2)) AS i
        FROM d, (SELECT DISTINCT wide FROM bw) WHERE len(w) >= wide) k),
hit AS (SELECT dw.doc_id, dw.i, dw.wide, bw.item_id FROM dw JOIN bw USING (win)),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + wide)) AS p FROM (SELECT DISTINCT doc_id, i, wide FROM hit))
  GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowwatch.llm.benchmark import contamination, digest

    return digest(contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op7_substring_dedup", """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
win AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least_doc AS (SELECT win, min(doc_id) AS low FROM win GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS p
  FROM win JOIN least_doc USING (win) WHERE low < doc_id),
word AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n
  FROM word ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowwatch.llm.substrings import digest, removals

    return digest(removals(table(spark, sf_dir, "documents")))


@query("op5_source_mix")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowwatch.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowwatch.llm.credentials import digest, scan

    return digest(scan(table(spark, sf_dir, "documents")))


@query("op10_main_text")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowwatch.llm.wrappers import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


@query("op9_minhash_neardup", """
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT r, doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
rare AS MATERIALIZED (  -- the ceil(n / 4) rarest shingles of one of two linked sets hold one of the other's
  SELECT r, s, p, n FROM (
    SELECT r, s, n, row_number() OVER (PARTITION BY r ORDER BY c, s) AS p
    FROM s JOIN n USING (r) JOIN (SELECT s, count(*) AS c FROM s GROUP BY s) USING (s))
  WHERE p <= n - ceil(0.75 * n) + 1),
pairs AS (
  SELECT DISTINCT a.r AS a, b.r AS b FROM rare a JOIN rare b USING (s)
  WHERE a.r < b.r AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT a, b, count(*) AS shared FROM pairs JOIN s x ON x.r = a JOIN s y ON y.r = b AND y.s = x.s GROUP BY a, b)
  JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
edges AS MATERIALIZED (
  SELECT x.doc_id AS u, y.doc_id AS v FROM links JOIN d x ON x.r = a JOIN d y ON y.r = b
  UNION SELECT y.doc_id, x.doc_id FROM links JOIN d x ON x.r = a JOIN d y ON y.r = b),
walk AS (
  SELECT u, u AS c FROM edges UNION SELECT e.u, walk.c FROM walk JOIN edges e ON e.v = walk.u WHERE walk.c < e.u),
comp AS (SELECT u, min(c) AS c FROM walk GROUP BY u)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(least(c, doc_id), doc_id) AS component_id,
  doc_id = coalesce(least(c, doc_id), doc_id) AS kept
FROM d LEFT JOIN n USING (r) LEFT JOIN comp ON u = doc_id
""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowwatch.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_embedding_neardup", """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.93),
walk AS (SELECT a, a AS c FROM links UNION SELECT l.a, w.c FROM walk w JOIN links l ON l.b = w.a WHERE w.c < l.a),
comp AS (SELECT a, least(a, min(c)) AS c FROM walk GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id,
  coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN comp ON comp.a = vec_id
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowwatch.llm.nndescent import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowwatch.llm.quality import digest, judged

    return digest(judged(table(spark, sf_dir, "documents")))


@query("op6_preference_format", """
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS tie
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
last AS (SELECT conv_id, max({'turn': turn, 'tie': tie}) AS last FROM t WHERE role = 'assistant' GROUP BY conv_id),
r AS (
  SELECT conv_id, turn, role, CASE WHEN {'turn': turn, 'tie': tie} = last THEN array_to_string(
    string_split(text, ' ')[1:greatest(1, len(string_split(text, ' ')) // 2)], ' ') ELSE text END AS text
  FROM t JOIN last USING (conv_id)),
rt AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS tie FROM (SELECT DISTINCT * FROM r)),
a AS (
  SELECT coalesce(t.conv_id, rt.conv_id) AS conv_id, coalesce(t.turn, rt.turn) AS turn, coalesce(t.tie, rt.tie) AS tie,
    t.role AS c_role, t.text AS c_text, rt.role AS r_role, rt.text AS r_text
  FROM t FULL JOIN rt ON t.conv_id = rt.conv_id AND t.turn = rt.turn AND t.tie = rt.tie),
split AS (
  SELECT conv_id, min({'turn': turn, 'tie': tie}) AS split FROM a
  WHERE c_role IS DISTINCT FROM r_role OR c_text IS DISTINCT FROM r_text GROUP BY conv_id),
parts AS (
  SELECT conv_id, 'prompt' AS part, turn, tie, c_role AS role, c_text AS text FROM a JOIN split USING (conv_id)
  WHERE {'turn': turn, 'tie': tie} < split
  UNION ALL SELECT conv_id, 'chosen', turn, tie, c_role, c_text FROM a JOIN split USING (conv_id)
  WHERE {'turn': turn, 'tie': tie} >= split AND c_role IS NOT NULL
  UNION ALL SELECT conv_id, 'rejected', turn, tie, r_role, r_text FROM a JOIN split USING (conv_id)
  WHERE {'turn': turn, 'tie': tie} >= split AND r_role IS NOT NULL)
SELECT conv_id, part, turn, CAST(tie AS INTEGER) AS tie, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
  CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 ELSE 0 END AS INTEGER) AS mask_start,
  CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(role) + 5 + length(text) + 8 ELSE 0 END AS INTEGER) AS mask_end
FROM parts WHERE conv_id IN (SELECT conv_id FROM last)
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowwatch.llm.preferences import cut_replies, preferences

    conversations = table(spark, sf_dir, "conversations")
    return preferences(conversations, cut_replies(conversations))


@query("op13_fill_in_middle", """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
    sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
k AS (
  SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
           OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
         WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM d),
p AS (
  SELECT *, array_to_string(u[1:least(a, b)], '') AS prefix, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle,
    array_to_string(u[greatest(a, b) + 1:n], '') AS suffix
  FROM k)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowwatch.llm.middles import digest, fill_in_middle

    return digest(fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op12_lm_scores")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from flowwatch.llm.attention import scored

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        return scored(table(spark, sf_dir, "documents"), lines.read())


@query("op11_prefix_trie", """
WITH crc AS (  -- table of the polynomial of crc32
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS tab),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(
    [4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = base WHERE pos < h
  UNION ALL SELECT conv_id, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
p AS (
  SELECT conv_id, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY pos) AS p, length(text) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY pos) = count(*) OVER (PARTITION BY conv_id) AS whole
  FROM r
  UNION ALL SELECT conv_id, [], 0, conv_id NOT IN (SELECT conv_id FROM r) FROM c),
n AS (
  SELECT p, len(p) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE whole), '')) AS ends
  FROM p GROUP BY p),
kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
up AS (
  SELECT p[1:k] AS p, sum((n_convs - 1) * chars) AS saved, count(*) FILTER (WHERE p NOT IN (SELECT p FROM kids)) AS leaves
  FROM (SELECT p, n_convs, chars, unnest(range(0, depth + 1)) AS k FROM n) GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, n.n_convs,
  CAST(coalesce(n_children, 0) AS BIGINT) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends AS ends_sha256
FROM n JOIN up USING (p) LEFT JOIN kids USING (p)
LEFT JOIN n AS parent ON n.depth > 0 AND parent.p = n.p[1:n.depth - 1]
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowwatch.llm.tries import digest, prefix_trie

    return digest(prefix_trie(table(spark, sf_dir, "conversations")))

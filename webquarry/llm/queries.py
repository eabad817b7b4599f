"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webquarry.llm import clustering, conversation_repair, decontaminate, exact_dedup, langid, maxent_lm, mixing, near_dedup, packing, sharding, substring_dedup, suffix_dedup, topk


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_docs(spark, sf_dir)).drop("kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "position")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(_docs(spark, sf_dir), shards=16)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_docs(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_docs(spark, sf_dir), tokenizer())


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_docs(spark, sf_dir))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(_docs(spark, sf_dir)).drop("kept")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_docs(spark, sf_dir))


def op9_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op10_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.scored(_docs(spark, sf_dir), maxent_lm.fold_of() % 7 == 2)


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.verdicts(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_dual_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents)
"""

OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(doc_id::VARCHAR) AS r,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (  -- by the ratio at which a source is full
  SELECT *, 2.0::DOUBLE * source_size / w AS full_at, sum(source_size) OVER () * 1.5::DOUBLE AS budget FROM s),
c AS (
  SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_me,
         sum(w) OVER (ORDER BY full_at DESC, source DESC ROWS UNBOUNDED PRECEDING) AS w_left FROM o),
l AS (SELECT max((budget - before_me) / w_left) AS rate FROM c),
t AS (SELECT source, source_size, w, CASE WHEN full_at < rate THEN 2.0::DOUBLE * source_size ELSE rate * w END AS target FROM o, l),
x AS (
  SELECT d.*, t.source_size, t.w, t.target, floor(t.target + 0.5)::BIGINT AS quota,
         sum(size) OVER (PARTITION BY d.source ORDER BY r ROWS UNBOUNDED PRECEDING) - size AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (least(size, greatest(0, quota - b)) + least(size, greatest(0, quota - b - source_size)))::BIGINT AS taken,
       CASE WHEN size > 0 AND b < quota THEN
         CASE w WHEN 5 THEN (sqrt(greatest(0.0::DOUBLE, 1.5::DOUBLE * 1.5::DOUBLE + 2 * -1.0::DOUBLE * (b::DOUBLE / quota))) - 1.5::DOUBLE) / -1.0::DOUBLE
                WHEN 1 THEN (sqrt(greatest(0.0::DOUBLE, 0.5::DOUBLE * 0.5::DOUBLE + 2 * 1.0::DOUBLE * (b::DOUBLE / quota))) - 0.5::DOUBLE) / 1.0::DOUBLE
                ELSE b::DOUBLE / quota END END AS position
FROM x
"""

OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, z, substr(x, 2 * z + 1, 1398) AS y FROM (SELECT r, x, unnest(range(0, strlen(x) // 2, 500)) AS z FROM d)),
s AS (SELECT r, z + i AS i, md5_number(substr(y, 2 * i + 1, 400)) AS h FROM (SELECT r, z, y, unnest(range(0, least(500, strlen(y) // 2 - 199))) AS i FROM c)),
t AS (SELECT r, i FROM s QUALIFY count(*) OVER (PARTITION BY h) > 1),
g AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS last FROM t),
b AS (SELECT r, i, sum((last IS NULL OR i > last + 200)::INT) OVER (PARTITION BY r ORDER BY i) AS span FROM g),
p AS (
  SELECT r, min(i) AS low, max(i) + 200 AS high FROM b GROUP BY r, span
  UNION ALL SELECT r, strlen(x) // 2, strlen(x) // 2 FROM d),
q AS (SELECT r, low, high, lag(high, 1, 0) OVER (PARTITION BY r ORDER BY low, high) AS since FROM p),
k AS (
  SELECT r, sum(high - low)::BIGINT AS n_removed, count(*) FILTER (high > low) AS n_spans,
         string_agg(substr(x, 2 * since + 1, 2 * (low - since)), '' ORDER BY low, high) AS kept FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, (strlen(x) // 2)::BIGINT AS n_bytes, n_removed, n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN k USING (r)
"""

OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
h AS (SELECT r, n, i, word, md5_number(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h FROM s),
m AS (SELECT r, i, word, count(*) FILTER (i + 34 <= n) OVER (PARTITION BY h) > 1 AND i + 34 <= n AS twice FROM h),
c AS (SELECT r, i, word, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

OP8_SQL = r"""
WITH RECURSIVE t AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS id, count(*) AS n, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents GROUP BY ALL),
u AS (SELECT id, len(w) AS words, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM t),
g AS (
  SELECT id, words, i, md5_number(string_agg(word, ' ') OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) AS h FROM u),
s AS (SELECT id, h, count(*) AS n FROM g WHERE i <= greatest(words - 4, 1) GROUP BY id, h),
z AS (SELECT id, sum(n) AS total FROM s GROUP BY id),
o AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS shared FROM s a JOIN s b ON a.h = b.h AND a.id <> b.id GROUP BY a.id, b.id),
l AS (SELECT a, b FROM o JOIN z za ON za.id = a JOIN z zb ON zb.id = b WHERE 9 * shared >= 4 * (za.total + zb.total)),
m AS (SELECT id AS a, id AS b FROM t UNION SELECT m.a, l.b FROM m JOIN l ON m.b = l.a),
c AS (SELECT a AS id, min(b) AS class_id FROM m GROUP BY a),
f AS (SELECT class_id, sum(n)::BIGINT AS class_size FROM c JOIN t USING (id) GROUP BY class_id)
SELECT doc_id, class_id, class_size, doc_id = class_id AS kept
FROM documents d JOIN t ON coalesce(d.text, '') = t.text JOIN c USING (id) JOIN f USING (class_id)
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

OP11_SQL = r"""
WITH l AS (
  SELECT 'd' AS kind, row_number() OVER () AS r, doc_id::VARCHAR AS id, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 'b', row_number() OVER (), coalesce(item_id::VARCHAR, ''), NULL,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
b AS (SELECT id, w, least(10, len(w)) AS size FROM l WHERE kind = 'b' AND len(w) > 0),
t AS (SELECT DISTINCT id, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM b)),
d AS (SELECT r, doc_id, w FROM l WHERE kind = 'd'),
p AS (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM b)),
f AS (SELECT p.r, p.i, p.size, t.id FROM (SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM p) p JOIN t USING (size, phrase)),
h AS (SELECT r, count(DISTINCT z) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS z FROM f) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM f) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN g USING (r)
"""


def _op12_sql(rounds: int = 10) -> str:
    """Plain Lloyd, unrolled; whole numbers in DOUBLE below 2^53 are exact."""
    assign = """a{k} AS MATERIALIZED (
  SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
  FROM (SELECT r, cluster, list_dot_product(v.v, v.v) - 2 * list_dot_product(v.v, c.v) + list_dot_product(c.v, c.v) AS d FROM v, c{k} c) GROUP BY r),
"""
    move = """c{n} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT cluster, list(((s - (s % n + n) % n) // n)::DOUBLE ORDER BY i) AS v
    FROM (SELECT cluster, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{k} JOIN v USING (r)) GROUP BY ALL) GROUP BY cluster) m USING (cluster)),
"""
    return (
        """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS cluster, v
  FROM (SELECT sha256('3:' || vec_id::VARCHAR) AS h, v FROM v ORDER BY h NULLS LAST, v LIMIT 8)),
"""
        + "".join(assign.format(k=k) + move.format(k=k, n=k + 1) for k in range(rounds))
        + assign.format(k=rounds)
        + f"""s AS (SELECT cluster, sum(d)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, a.cluster::INTEGER AS cluster, d::BIGINT AS distance, cluster_inertia, (SELECT sum(d)::BIGINT FROM a{rounds}) AS inertia,
       sha256(array_to_string(list_transform(c.v, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (r) JOIN s USING (cluster) JOIN c{rounds} c USING (cluster)
"""
    )


OP12_SQL = _op12_sql()


def _op13_sql() -> str:
    """The DP forwards, a conversation's rows one by one; its keys are cost (six digits) and edits, so the least key wins."""
    states = "nsua"  # nothing yet, after system, after user, after assistant
    none = "{'k': '9', 't': ''}"

    def then(v: str, cost: str, letter: str, line: str = "''") -> str:
        return f"CASE WHEN {v}.k < '9' THEN {{'k': lpad((left({v}.k, 6)::INT + {cost})::VARCHAR, 6, '0') || substr({v}.k, 7) || '{letter}', 't': {v}.t || {line}}} ELSE {none} END"

    least = lambda *x: f"list_sort([{', '.join(x)}])[1]"
    line = lambda role: f"({role} || ':' || text || chr(10))"
    new = lambda role: f"'{role}:' || chr(10)"
    inserted_u = least("u", *[then(x, "2", "I", new("user")) for x in "nsa"])
    inserted_a = least("a", then("u", "2", "I", new("assistant")))
    kept = lambda x, initial: f"CASE WHEN fault IN (0, 3) AND initial = '{initial}' THEN {then(x, '(fault = 3)::INT', 'K', line('role'))} ELSE {none} END"
    turned = lambda x, role: f"CASE WHEN fault IN (0, 3) THEN {then(x, '2 + (fault = 3)::INT', 'R', line(chr(39) + role + chr(39)))} ELSE {none} END"
    gone = lambda x: then(x, "3", "D")
    step = {
        "n": gone("n"),
        "s": least(gone("s"), kept("n", "s")),
        "u": least(gone("u"), *[f(x, y) for x in "nsa" for f, y in ((kept, "u"), (turned, "user"))]),
        "a": least(gone("a"), kept("u", "a"), turned("u", "assistant")),
    }
    inserts = lambda table, keep: f"(SELECT {keep}, n, s, u, {inserted_a} AS a FROM (SELECT {keep}, n, s, a, {inserted_u} AS u FROM {table}))"
    # a second insertion may follow the first; after it the costs of all states are settled
    opened = inserts(inserts("(SELECT w.*, role, text, fault, initial FROM w JOIN e ON e.c = w.c AND e.i = w.z + 1)", "c, z, role, text, fault, initial"), "c, z, role, text, fault, initial")
    closed = inserts(inserts("(SELECT * FROM w WHERE NOT EXISTS (FROM e WHERE e.c = w.c AND e.i = w.z + 1))", "c, z"), "c, z")
    return f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END) ORDER BY i) AS t FROM range(256) r(i)),
o AS (SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
k AS (SELECT o.*, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda ch: ascii(ch)::BIGINT)),
        lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1]))) % 20 AS h FROM o, crc),
g AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
        CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, h, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k),
f AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i,
        left(role, 1) AS initial, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS y FROM g),
e AS MATERIALIZED (SELECT c, i, turn, role, text, initial, CASE WHEN y = '' THEN 1 WHEN later THEN 2 WHEN y NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
        coalesce(lag(initial) OVER (PARTITION BY c ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS odd
      FROM (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS later FROM f)),
q AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
w AS (
  SELECT c, 0 AS z, {{'k': '000000', 't': ''}} AS n, {none} AS s, {none} AS u, {none} AS a FROM (SELECT DISTINCT c FROM e)
  UNION ALL
  SELECT c, z + 1, {step['n']}, {step['s']}, {step['u']}, {step['a']} FROM {opened}),
z AS (SELECT c, {least('n', 'a')} AS best FROM {closed}),
m AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (odd) AS illegal FROM e GROUP BY c)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(left(best.k, 6)::BIGINT, 0) AS cost, coalesce(substr(best.k, 7), '') AS audit, sha256(coalesce(best.t[:-2], '')) AS repaired_sha256
FROM q LEFT JOIN m USING (c) LEFT JOIN z USING (c)
"""


OP13_SQL = _op13_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_exact_topk": op9_exact_topk,
    "op10_maxent_lm": op10_maxent_lm,
    "op11_decontamination": op11_decontamination,
    "op12_dual_tree_lloyd": op12_dual_tree_lloyd,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_array_dedup": OP1_SQL,
    "op2_mixing": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op8_minhash_near_dedup": OP8_SQL,
    "op9_exact_topk": OP9_SQL,
    "op11_decontamination": OP11_SQL,
    "op12_dual_tree_lloyd": OP12_SQL,
    "op13_conversation_repair": OP13_SQL,
}

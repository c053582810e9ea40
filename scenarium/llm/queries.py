"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: SQL for the CRC-32 of an ASCII text: a table of one row ``crc(t)`` from the polynomial's rule, and an expression over it.
CRC_TABLE = """crc AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"""


def crc_sql(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenarium.llm.simhash import near_duplicate_groups

    groups = near_duplicate_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scenarium.llm.bpe import encode

    return encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)


@_query
def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenarium.llm.langid import fit, predict, remainder

    docs = _table(spark, sf_dir, "documents")
    out = predict(docs, fit(docs, remainder(4) != 2))
    return out.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@_query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenarium.llm.pii import replace_pii

    return replace_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenarium.llm.decontam import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenarium.llm.topk import exact_top_k

    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLES["op1_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@_query
def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenarium.llm.langid import remainder
    from scenarium.llm.lm import score_language_model

    docs = _table(spark, sf_dir, "documents")
    out = score_language_model(docs, remainder(7) != 2)
    return out.select("doc_id", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenarium.llm.licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


@_query
def op7_fuzzy_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenarium.llm.chaining import fuzzy_passages, with_components

    return with_components(fuzzy_passages(_table(spark, sf_dir, "documents")))


@_query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenarium.llm.suffixes import remove_repeats

    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


ORACLES["op2_suffix_dedup"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(b[i + 1 : i + 100]) AS k FROM (SELECT doc_id, b, unnest(range(greatest(n - 99, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM w QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
g AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM r),
s AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
t AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS e FROM s GROUP BY doc_id, run),
p AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM t),
c AS (SELECT p.doc_id, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(hex(b[z + 1 : a]), '' ORDER BY a) AS kept, max(e) AS last FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, '') || hex(b[coalesce(last, 0) + 1 : ]))) AS kept_sha256 FROM d LEFT JOIN c ON c.doc_id = d.doc_id
"""


@_query
def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenarium.llm.jaccard import jaccard_groups

    return jaccard_groups(_table(spark, sf_dir, "documents"))


ORACLES["op13_jaccard_join"] = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1 : i + 5], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
two AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, two.y FROM reach r JOIN two ON two.x = r.y)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, coalesce(min(y), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.x = w.doc_id GROUP BY w.doc_id
"""


@_query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenarium.llm.merkle import manifest

    return manifest(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE {CRC_TABLE},
leaf AS (SELECT doc_id, lang, {_LEAF.format("n_chars")} AS leaf, {_LEAF.format("(n_chars + 1)")} AS other, coalesce({crc_sql("CAST(doc_id AS VARCHAR)")} % 7 = 0, false) AS hit FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaf),
up AS (
  SELECT lang, 0 AS lvl, pos, n, leaf AS node FROM placed
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(node || coalesce(next, ''))
  FROM (SELECT *, lead(node) OVER (PARTITION BY lang ORDER BY pos) AS next FROM up WHERE n > 1) WHERE pos % 2 = 0
),
sub AS (SELECT lang, node, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, n, node FROM sub
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(node || coalesce(next, ''))
  FROM (SELECT *, lead(node) OVER (ORDER BY pos) AS next FROM top WHERE n > 1) WHERE pos % 2 = 0
),
steps AS (
  SELECT p.lang, p.pos, a.lvl, CASE WHEN b.node IS NULL THEN '-' WHEN b.pos < a.pos THEN 'L' || b.node ELSE 'R' || b.node END AS step
  FROM placed p JOIN up a ON a.lang IS NOT DISTINCT FROM p.lang AND a.pos = p.pos >> a.lvl AND a.n > 1
  LEFT JOIN up b ON b.lang IS NOT DISTINCT FROM a.lang AND b.lvl = a.lvl AND b.pos = xor(a.pos, 1)
  UNION ALL
  SELECT p.lang, p.pos, 1000 + a.lvl, CASE WHEN b.node IS NULL THEN '-' WHEN b.pos < a.pos THEN 'L' || b.node ELSE 'R' || b.node END
  FROM placed p JOIN sub s ON s.lang IS NOT DISTINCT FROM p.lang JOIN top a ON a.pos = s.pos >> a.lvl AND a.n > 1
  LEFT JOIN top b ON b.lvl = a.lvl AND b.pos = xor(a.pos, 1)
),
way AS (SELECT lang, pos, list(step ORDER BY lvl) AS steps FROM steps GROUP BY lang, pos),
done AS (
  SELECT doc_id, leaf, s.node AS subroot, (SELECT node FROM top WHERE n = 1) AS root, coalesce(steps, []) AS steps,
    list_reduce(list_prepend(CASE WHEN hit AND other IS NOT NULL THEN other ELSE leaf END, coalesce(steps, [])),
      lambda x, y: sha256(CASE y[1] WHEN 'L' THEN y[2:] || x WHEN 'R' THEN x || y[2:] ELSE x END)) AS folded_root
  FROM placed p JOIN sub s ON s.lang IS NOT DISTINCT FROM p.lang LEFT JOIN way w ON w.lang IS NOT DISTINCT FROM p.lang AND w.pos = p.pos
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda x: x[2:]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
"""


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scenarium.llm.conversations import repair

    return repair(_table(spark, sf_dir, "conversations"))


_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLES["op12_conversation_repair"] = f"""
WITH RECURSIVE {CRC_TABLE},
given AS (
  SELECT coalesce(CAST(conv_id AS VARCHAR), '') AS c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
),
kinds AS (SELECT *, {crc_sql("key")} % 20 AS kind FROM given, crc),
damaged AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(strlen(role) || ':' || role || text), copy) - 1 AS n, right(rtrim(text, {_SPACES}), 1) AS last FROM damaged),
r AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(role[1]) OVER (PARTITION BY c ORDER BY n) || role[1] AS pair FROM placed
),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS rows FROM r GROUP BY c
),
turned(state, next, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
own(state, letter, cost, initial, next, role) AS (
  SELECT * FROM (VALUES (0, 'K', 0, 's', 1, CAST(NULL AS VARCHAR)), (0, 'K', 0, 'u', 2, NULL), (1, 'K', 0, 'u', 2, NULL), (3, 'K', 0, 'u', 2, NULL), (2, 'K', 0, 'a', 3, NULL))
  UNION ALL SELECT state, 'R', 3, CAST(NULL AS VARCHAR), next, role FROM turned
),
moves AS (
  SELECT state, '' AS pre, '' AS letters, 0 AS cost, letter, cost AS own_cost, initial, next, role FROM own
  UNION ALL SELECT t.state, t.role || ':', 'I', 3, letter, o.cost, initial, o.next, o.role FROM turned t JOIN own o ON o.state = t.next
  UNION ALL SELECT state, '', '', 0, 'D', 4, NULL, state, NULL FROM turned
),
dp AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS n, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'repaired': ''}} AS best FROM given
  UNION ALL
  SELECT c, n, state, best FROM (
    SELECT d.c, d.n + 1 AS n, m.next AS state, min({{'cost': CAST(d.best.cost + m.cost + m.own_cost + CASE WHEN r.fault = 'truncated' AND letter <> 'D' THEN 3 ELSE 0 END AS BIGINT),
      'audit': d.best.audit || m.letters || m.letter,
      'repaired': d.best.repaired || CASE WHEN pre <> '' THEN pre || chr(10) ELSE '' END || CASE letter WHEN 'D' THEN '' ELSE coalesce(m.role, r.role) || ':' || r.text || chr(10) END}}) AS best
    FROM dp d JOIN r ON r.c = d.c AND r.n = d.n JOIN moves m ON m.state = d.state
      AND (m.letter = 'D' OR r.fault NOT IN ('blank', 'duplicate') AND (m.letter = 'R' OR m.initial = r.role[1]))
    GROUP BY d.c, d.n, m.next)
),
ends(state, cost, letters, more) AS (VALUES (0, 0, '', ''), (1, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 3, 'I', 'assistant:' || chr(10)), (3, 0, '', '')),
done AS (
  SELECT d.c, min({{'cost': d.best.cost + e.cost, 'audit': d.best.audit || e.letters, 'repaired': d.best.repaired || e.more}}) AS best
  FROM dp d JOIN ends e ON e.state = d.state LEFT JOIN counts k ON k.c = d.c WHERE d.n = coalesce(k.rows, 0) GROUP BY d.c
)
SELECT CAST(nullif(d.c, '') AS BIGINT) AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(left(best.repaired, greatest(length(best.repaired) - 1, 0))) AS repaired_sha256
FROM done d LEFT JOIN counts k ON k.c = d.c
"""

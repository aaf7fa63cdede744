"""The opN_ queries over their whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chatformat, decontam, langid, mixing, prefixtrie, quality, repair, secrets, sharding, simhash, suffixdedup, topk, warc
from .common import table


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, query_step=50)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs).drop("__row")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.deduplicate(table(spark, sf_dir, "documents"), width=400).drop("kept")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.report(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_exact_topk, op2_decontaminate, op3_quality, op4_mix, op5_shard, op6_secrets, op7_simhash, op8_suffix_dedup,
    op9_language, op10_warc, op11_prefix_trie, op12_repair, op13_chat_format)}

_UNITS = ", ".join(f"'{u}'" for u in decontam.UNITS)
_TOKENS = r"regexp_extract_all(text, '[\p{L}\p{N}][\p{L}\p{N}.!?]*')"
_TEMPLATE = f"""list_transform(words, lambda w, i: CASE
  WHEN rtrim(w, '.!?') >= '0' AND rtrim(w, '.!?') < ':' THEN '#'
  WHEN lower(rtrim(w, '.!?')) IN ({_UNITS}) AND i > 1 AND words[i - 1] >= '0' AND words[i - 1] < ':' THEN '%'
  WHEN rtrim(w, '.!?') <> lower(rtrim(w, '.!?')) AND rtrim(w, '.!?') <> upper(rtrim(w, '.!?')) AND i > 1
       AND right(words[i - 1], 1) NOT IN ('.', '!', '?') THEN '@'
  ELSE lower(rtrim(w, '.!?')) END)"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    chars = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    bits = "list_reduce(range(8), lambda q, i: xor(q >> 1, CASE WHEN q & 1 = 1 THEN 3988292384 ELSE 0 END), xor(r, b))"
    return f"xor(list_reduce({chars}, lambda r, b: {bits}, CAST(4294967295 AS BIGINT)), 4294967295)"


_BY_TURN = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"

ORACLES = {
    "op1_exact_topk": """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.row, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.row <> q.row),
r AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op2_decontaminate": f"""
WITH item AS (SELECT text, min(item_id) AS item_id FROM benchmark WHERE text IS NOT NULL GROUP BY text),
iw AS (SELECT text, item_id, {_TOKENS} AS words FROM item),
it AS (SELECT text, item_id, list_transform(words, lambda w: rtrim(w, '.!?')) AS plain, {_TEMPLATE} AS t FROM iw),
ip AS (SELECT *, unnest(range(1, len(t) - 3)) AS ipos FROM it),
iq AS (SELECT text, item_id, ipos, array_to_string(t[ipos:ipos + 4], ' ') AS h, plain[ipos:ipos + 4] AS iv,
              list_transform(t[ipos:ipos + 4], lambda x: x NOT IN ('#', '@', '%')) AS literal FROM ip),
items AS (SELECT *, count(*) OVER (PARTITION BY text) AS total FROM iq WHERE len(list_filter(literal, lambda x: x)) >= {decontam.LITERALS}),
dw AS (SELECT doc_id, {_TOKENS} AS words FROM documents WHERE text IS NOT NULL),
dt AS (SELECT doc_id, list_transform(words, lambda w: rtrim(w, '.!?')) AS plain, {_TEMPLATE} AS t FROM dw),
dp AS (SELECT *, unnest(range(1, len(t) - 3)) AS pos FROM dt),
dq AS (SELECT doc_id, pos, array_to_string(t[pos:pos + 4], ' ') AS h, plain[pos:pos + 4] AS v FROM dp),
hit AS (SELECT doc_id, text, item_id, total, ipos, pos - ipos AS diagonal, iv, v, literal FROM dq JOIN items USING (h)),
bind AS (SELECT doc_id, text, diagonal, iv[j] AS a, v[j] AS b
         FROM hit, (SELECT unnest(range(1, 6)) AS j) WHERE NOT literal[j]),
broken AS (SELECT doc_id, text, diagonal FROM bind GROUP BY ALL
           HAVING count(DISTINCT (a, b)) <> count(DISTINCT a) OR count(DISTINCT (a, b)) <> count(DISTINCT b)),
held AS (SELECT doc_id, text, item_id, count(DISTINCT ipos) / CAST(min(total) AS DOUBLE) AS share
         FROM hit ANTI JOIN broken USING (doc_id, text, diagonal) GROUP BY doc_id, text, item_id),
best AS (SELECT doc_id, item_id, share, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, item_id) AS n
         FROM held WHERE share >= 0.8)
SELECT d.doc_id, b.share IS NOT NULL AS contaminated, b.item_id, b.share
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id AND b.n = 1""",
    "op4_mix": f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT *, sqrt(n) AS w, sum(sqrt(n)) OVER () AS total, least({mixing.PERIOD}.0, {mixing.WORK}.0 / count(*) OVER ()) AS most FROM n),
w AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST) AS s, source, n,
             CAST(greatest(1, floor(w * CASE WHEN total > most THEN most / total ELSE 1 END + 0.5)) AS BIGINT) AS a FROM t),
src AS (SELECT list(a ORDER BY s) AS a, CAST(sum(a) AS BIGINT) AS q FROM w),
edf(t, had, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform((SELECT a FROM src), lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT)
  UNION ALL
  SELECT t + 1, list_transform(had, lambda c, i: c + CASE WHEN i = pick THEN 1 ELSE 0 END),
         list_min(list_transform(list_filter(range(1, len(a) + 1),
             lambda i: (had[i] + CASE WHEN i = pick THEN 1 ELSE 0 END) * q // a[i] <= t + 1),
           lambda i: ((had[i] + CASE WHEN i = pick THEN 1 ELSE 0 END + 1) * q + a[i] - 1) // a[i] * 100000 + i)) % 100000
  FROM edf, src WHERE t + 1 < q),
period AS (SELECT t AS r, pick AS s, had[pick] AS k FROM edf WHERE t >= 0),
ranked AS (SELECT d.doc_id, d.source, w.s, w.a,
                  row_number() OVER (PARTITION BY w.s ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id) - 1 AS nth
           FROM documents d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
blocks AS (SELECT *, nth // {mixing.BLOCK_ROWS} AS block FROM ranked),
placed AS (SELECT b.*, b.block // b.a * q + p.r AS slot, q FROM blocks b JOIN period p ON b.s = p.s AND b.block % b.a = p.k, src)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(slot AS BIGINT) AS slot, CAST(block * q // a AS BIGINT) AS release,
       CAST(((block + 1) * q + a - 1) // a AS BIGINT) AS deadline,
       row_number() OVER (ORDER BY slot, nth) - 1 AS position
FROM placed""",
    "op10_warc": f"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, max(page_id) AS m FROM p WHERE n >= {warc.MIN_REVISIT} GROUP BY d)
SELECT p.page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN m IS DISTINCT FROM p.page_id AND m IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m IS DISTINCT FROM p.page_id THEN m END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= {warc.MIN_REVISIT}""",
    "op11_prefix_trie": f"""
WITH own AS (
  SELECT conv_id, row_number() OVER ({_BY_TURN}) AS nth, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, list(sha256(role) || sha256(text) ORDER BY nth) AS keys, list(strlen(text) ORDER BY nth) AS sizes,
         {_crc32("CAST(conv_id AS VARCHAR)")} % 9 AS h
  FROM own GROUP BY conv_id),
path AS (
  SELECT c.conv_id, list_concat(coalesce(b.keys[1:c.h], []), c.keys[c.h + 1:]) AS keys,
         list_concat(coalesce(b.sizes[1:c.h], []), c.sizes[c.h + 1:]) AS sizes
  FROM conv c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 5),
deep AS (SELECT *, unnest(range(0, len(keys) + 1)) AS depth FROM path),
member AS (
  SELECT conv_id, depth, depth = len(keys) AS ends, sha256(array_to_string(keys[1:depth], '')) AS name,
         CASE WHEN depth > 0 THEN sha256(array_to_string(keys[1:depth - 1], '')) END AS parent,
         CASE WHEN depth > 0 THEN sizes[depth] ELSE 0 END AS bytes
  FROM deep),
node AS (
  SELECT depth, name, parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended
  FROM member GROUP BY depth, name, parent),
kids AS (SELECT parent AS name, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY parent),
grown AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (name)),
total AS (
  SELECT m.name, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves, CAST(sum((u.n_convs - 1) * u.bytes) AS BIGINT) AS saved_tokens
  FROM grown u JOIN member m ON m.conv_id = u.conv_id AND m.depth <= u.depth GROUP BY m.name)
SELECT g.conv_id, CAST(g.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, g.n_convs, g.n_children, t.n_leaves, t.saved_tokens,
       sha256(g.ended) AS ends_sha256
FROM grown g JOIN total t USING (name) LEFT JOIN grown p ON g.parent = p.name""",
    "op12_repair": f"""
WITH RECURSIVE struck AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
  FROM conversations),
harmed AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM struck WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER ({_BY_TURN}) AS nth,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS shown FROM harmed),
judged AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN shown = '' THEN 'blank'
              WHEN nth > min(nth) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
              WHEN right(shown, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault
  FROM placed),
pairs AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY nth) || initial AS pair FROM judged),
found AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated,
         count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM pairs GROUP BY conv_id),
rule(state, op, needs, leads, price, role) AS (VALUES
  ('', 'D', NULL, '', 2, NULL), ('s', 'D', NULL, 's', 2, NULL), ('u', 'D', NULL, 'u', 2, NULL), ('a', 'D', NULL, 'a', 2, NULL),
  ('', 'K', 's', 's', 0, NULL), ('', 'K', 'u', 'u', 0, NULL), ('s', 'K', 'u', 'u', 0, NULL), ('u', 'K', 'a', 'a', 0, NULL),
  ('a', 'K', 'u', 'u', 0, NULL), ('', 'R', NULL, 'u', 1, 'user'), ('s', 'R', NULL, 'u', 1, 'user'),
  ('u', 'R', NULL, 'a', 1, 'assistant'), ('a', 'R', NULL, 'u', 1, 'user')),
hop(state, leads, ins, price, made) AS (VALUES
  ('', '', '', 0, []), ('s', 's', '', 0, []), ('u', 'u', '', 0, []), ('a', 'a', '', 0, []),
  ('', 'u', 'I', 5, ['user:']), ('s', 'u', 'I', 5, ['user:']), ('u', 'a', 'I', 5, ['assistant:']), ('a', 'u', 'I', 5, ['user:']),
  ('', 'a', 'II', 10, ['user:', 'assistant:']), ('s', 'a', 'II', 10, ['user:', 'assistant:'])),
way(conv_id, nth, state, cost, audit, made) AS (
  SELECT conv_id, CAST(0 AS BIGINT), '', CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM found
  UNION ALL
  SELECT conv_id, nth, leads, unnest(best) FROM (
    SELECT conv_id, nth, leads, arg_min({{'cost': cost, 'audit': audit, 'made': made}}, (cost, audit)) AS best FROM (
      SELECT w.conv_id, j.nth, r.leads, w.audit || h.ins || r.op AS audit,
             CAST(w.cost + h.price + r.price + CASE WHEN j.fault = 'truncated' AND r.op <> 'D' THEN 5 ELSE 0 END AS BIGINT) AS cost,
             w.made || h.made || CASE WHEN r.op = 'D' THEN [] ELSE [coalesce(r.role, j.role) || ':' || j.text] END AS made
      FROM way w JOIN judged j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.nth = w.nth + 1
           JOIN hop h ON h.state = w.state JOIN rule r ON r.state = h.leads
      WHERE (r.op = 'D' OR j.fault IS NULL OR j.fault = 'truncated') AND (r.needs IS NULL OR r.needs = j.initial)) x
    GROUP BY conv_id, nth, leads) y),
ended AS (
  SELECT f.conv_id, arg_min({{'cost': w.cost + h.price, 'audit': w.audit || h.ins, 'made': w.made || h.made}},
                            (w.cost + h.price, w.audit || h.ins)) AS best
  FROM found f JOIN way w ON w.conv_id IS NOT DISTINCT FROM f.conv_id AND w.nth = f.n JOIN hop h ON h.state = w.state
  WHERE h.leads IN ('', 'a') GROUP BY f.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.made, chr(10)), '')) AS repaired_sha256
FROM ids i LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id""",
    "op13_chat_format": f"""
WITH said AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT {chatformat.EXTRA_ID}, 0, 'user', '{chatformat.EXTRA_TEXT}'
  UNION ALL SELECT {chatformat.EXTRA_ID}, 1, 'assistant', '{chatformat.EXTRA_TEXT}'),
placed AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER ({_BY_TURN}) AS nth FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(regexp_replace(role || text, '[\\\\<>]', '..', 'g')) + length('<turn ></turn>') + 1) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id""",
}

"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

# CRC-32 byte by byte; the 256-entry table comes from the polynomial's rule.
SHARDING = """
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
  FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
sized AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size,
         CASE WHEN coalesce(text, '') = '' THEN 0 ELSE
           xor(list_reduce(
             list_prepend(4294967295::BIGINT, list_transform(
               string_split(rtrim(regexp_replace(hex(encode(text)), '(..)', '\\1 ', 'g')), ' '),
               lambda h: ('0x' || h)::BIGINT)),
             lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])), 4294967295::BIGINT)
         END AS text_crc32
  FROM documents, crc_table
),
draws AS (
  SELECT doc_id, level, node,
         -ln((('0x' || substr(md5(doc_id || '|' || level || '|' || node), 1, 12))::BIGINT + 0.5)
             / 281474976710656.0) / weight AS draw
  FROM (SELECT DISTINCT doc_id FROM documents), (
    SELECT 'region' AS level, range AS node, CASE WHEN range = 3 THEN 1.0 ELSE 8.0 END AS weight
    FROM range(4)
    UNION ALL SELECT 'rack', range, 4.0 FROM range(6)
    UNION ALL SELECT 'shard', range, 1.0 FROM range(24))
),
old_region AS (SELECT doc_id, arg_min(node, draw) AS region FROM draws
               WHERE level = 'region' AND node < 3 GROUP BY doc_id),
new_region AS (SELECT doc_id, arg_min(node, draw) AS region FROM draws
               WHERE level = 'region' GROUP BY doc_id),
rack AS (SELECT d.doc_id, arg_min(d.node, d.draw) AS rack FROM draws d JOIN old_region r
         ON d.doc_id = r.doc_id AND d.level = 'rack' AND d.node // 2 = r.region GROUP BY d.doc_id),
leaf AS (SELECT d.doc_id, arg_min(d.node, d.draw)::INTEGER AS shard FROM draws d JOIN rack r
         ON d.doc_id = r.doc_id AND d.level = 'shard' AND d.node // 4 = r.rack GROUP BY d.doc_id),
placed AS (
  SELECT s.*, l.shard, CASE WHEN n.region = 3 THEN 24 ELSE l.shard END::INTEGER AS grown_shard,
         floor((('0x' || substr(md5(s.doc_id || '|block'), 1, 12))::BIGINT + 0.5)
               / 281474976710656.0 * 1024) AS block
  FROM sized s JOIN leaf l USING (doc_id) JOIN new_region n USING (doc_id)
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard
                          ORDER BY block, doc_id, size, text_crc32) - 1 AS slot,
       grown_shard
FROM placed
"""

LINE_DEDUP = """
WITH parts AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), lines AS (
  SELECT doc_id, pos, line, length(trim(line)) - length(replace(trim(line), ' ', '')) + 1 AS words,
         row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS idx,
  FROM parts WHERE trim(line) <> ''
), summed AS (
  SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY pos) - words AS before FROM lines
), windows AS (
  SELECT doc_id, idx, string_agg(line, chr(10)) OVER stretch AS content,
         sum(words) OVER stretch AS held
  FROM summed WINDOW stretch AS (PARTITION BY doc_id ORDER BY before
                                 RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), sources AS (
  SELECT doc_id, idx, first_value(doc_id) OVER same AS sid, first_value(idx) OVER same AS sidx
  FROM windows WHERE held >= 50
  WINDOW same AS (PARTITION BY content ORDER BY doc_id, idx)
), diagonals AS (
  SELECT DISTINCT doc_id, sid, idx - sidx AS diag FROM sources
  WHERE doc_id <> sid OR idx <> sidx
), equal_lines AS (
  SELECT d.doc_id, d.sid, d.diag, a.pos, a.idx, a.words,
         a.idx - row_number() OVER (PARTITION BY d.doc_id, d.sid, d.diag ORDER BY a.idx) AS run
  FROM diagonals d JOIN lines a ON a.doc_id = d.doc_id
  JOIN lines b ON b.doc_id = d.sid AND b.idx = a.idx - d.diag AND b.line = a.line
), gone AS (
  SELECT DISTINCT doc_id, pos FROM (
    SELECT doc_id, pos, sum(words) OVER (PARTITION BY doc_id, sid, diag, run) AS held
    FROM equal_lines) WHERE held >= 50
), kept AS (
  SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.pos) AS text
  FROM parts p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id
), counted AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(k.text, '') END AS text,
       coalesce(c.n, 0) AS removed_lines
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN counted c USING (doc_id)
"""

_ESCAPED = "replace({0}, '\\', '\\\\')"
for _mark in ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"):
    _ESCAPED = f"replace({_ESCAPED}, '{_mark}', '{_mark[0]}\\{_mark[1:]}')"

CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), texts AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, ''
                             ORDER BY turn, role, text), '') AS loss,
         sum(length({_ESCAPED.format("role")}) + length({_ESCAPED.format("text")})
             + 24)::BIGINT AS formatted_chars
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars
FROM texts
"""

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWERED = f"translate({{0}}, '{_CAPITALS}', '{_CAPITALS.lower()}')"
_BITS = """bits(i, k, c) AS (
  SELECT range, 0, range::BIGINT FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END
  FROM bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8)"""


def _crc32(text: str) -> str:
    """CRC-32 of a text that is not empty; ``t`` is the table's column."""
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      string_split(rtrim(regexp_replace(hex(encode({text})), '(..)', '\\1 ', 'g')), ' '),
      lambda h: ('0x' || h)::BIGINT)),
    lambda acc, b: xor(acc >> 8, t[(xor(acc, b) & 255) + 1])), 4294967295::BIGINT)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(map(_field, fields)) + ")"


# Levels grow from the leaves; the fold then climbs them once a document.
MERKLE = f"""
WITH RECURSIVE {_BITS},
leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS grp, {_leaf("text")} AS leaf,
         CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf(_LOWERED.format("text"))} END AS changed
  FROM documents, crc_table
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY grp) AS n
  FROM leaves
), nodes(grp, level, pos, n, digest) AS (
  SELECT grp, 0, pos, n, leaf FROM placed
  UNION ALL
  SELECT grp, level + 1, pos // 8, ceil(n / 8)::BIGINT, sha256(string_agg(digest, '' ORDER BY pos))
  FROM nodes WHERE n > 1 GROUP BY grp, level, n, pos // 8
), subroots AS (
  SELECT grp, level AS height, digest AS subroot,
         row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE n = 1
), tops(level, pos, n, digest) AS (
  SELECT 0, pos, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, pos // 8, ceil(n / 8)::BIGINT, sha256(string_agg(digest, '' ORDER BY pos))
  FROM tops WHERE n > 1 GROUP BY level, n, pos // 8
), runs AS (
  SELECT grp, level, pos // 8 AS run, list(digest ORDER BY pos) AS members
  FROM nodes WHERE n > 1 GROUP BY grp, level, pos // 8
), top_runs AS (
  SELECT level, pos // 8 AS run, list(digest ORDER BY pos) AS members
  FROM tops WHERE n > 1 GROUP BY level, pos // 8
), climb(id, grp, level, pos, node, proof) AS (
  SELECT row_number() OVER (), grp, 0, pos, coalesce(changed, leaf), '' FROM placed
  UNION ALL
  SELECT c.id, c.grp, c.level + 1, c.pos // 8,
         sha256(array_to_string(m.members[1:c.pos % 8], '') || c.node
                || array_to_string(m.members[c.pos % 8 + 2:], '')),
         c.proof || array_to_string(m.members[1:c.pos % 8], '')
                 || array_to_string(m.members[c.pos % 8 + 2:], '')
  FROM climb c JOIN runs m ON m.grp = c.grp AND m.level = c.level AND m.run = c.pos // 8
), joined AS (
  SELECT c.id, c.grp, s.subroot, s.pos, c.node, c.proof
  FROM climb c JOIN subroots s ON s.grp = c.grp AND s.height = c.level
), rise(id, level, pos, node, proof) AS (
  SELECT id, 0, pos, node, proof FROM joined
  UNION ALL
  SELECT r.id, r.level + 1, r.pos // 8,
         sha256(array_to_string(m.members[1:r.pos % 8], '') || r.node
                || array_to_string(m.members[r.pos % 8 + 2:], '')),
         r.proof || array_to_string(m.members[1:r.pos % 8], '')
                 || array_to_string(m.members[r.pos % 8 + 2:], '')
  FROM rise r JOIN top_runs m ON m.level = r.level AND m.run = r.pos // 8
), top AS (SELECT level AS height, digest AS root FROM tops WHERE n = 1)
SELECT p.doc_id, p.leaf, j.subroot, top.root, sha256(r.proof) AS proof_sha256,
       r.node AS folded_root, r.node = top.root AS verified
FROM (SELECT *, row_number() OVER () AS id FROM placed) p
JOIN joined j ON j.id = p.id JOIN rise r ON r.id = p.id JOIN top ON top.height = r.level
"""

_WORDS = f"regexp_extract_all({_LOWERED.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_RUNS = """list_concat(w, list_concat(
    list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]),
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])))"""

IMPORTANCE = f"""
WITH RECURSIVE {_BITS},
docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
runs AS (SELECT row, unnest({_RUNS}) AS f FROM docs),
wanted AS (SELECT unnest({_RUNS}) AS f FROM (SELECT {_WORDS} AS w FROM benchmark)),
hashed AS (
  SELECT f, {_crc32("f")} % 10000 AS bucket
  FROM (SELECT f FROM runs UNION SELECT f FROM wanted), crc_table
), source AS (SELECT bucket, count(*) AS s FROM runs JOIN hashed USING (f) GROUP BY bucket),
target AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (f) GROUP BY bucket),
sums AS (SELECT (SELECT coalesce(sum(s), 0) FROM source)::DOUBLE + 10000 AS all_s,
                (SELECT coalesce(sum(t), 0) FROM target)::DOUBLE + 10000 AS all_t),
gains AS (
  SELECT b.range AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * all_s
                                            / ((coalesce(s, 0) + 1)::DOUBLE * all_t)))::BIGINT AS gain
  FROM range(10000) b LEFT JOIN source ON source.bucket = b.range
  LEFT JOIN target ON target.bucket = b.range, sums
), weights AS (
  SELECT row, count(*) AS n_features, sum(gain)::BIGINT AS weight
  FROM runs JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT d.doc_id, coalesce(len(d.w), 0) AS words, coalesce(n_features, 0) AS n_features,
         coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || d.doc_id), 1, 8))::BIGINT
                                                     + 0.5) / 4294967296)))::BIGINT AS score
  FROM docs d LEFT JOIN weights USING (row)
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY words >= 20 DESC, score DESC, doc_id) AS place,
         (5 * count(*) FILTER (words >= 20) OVER ()) // 100 AS drawn
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= drawn THEN place END AS rank FROM ranked
"""

ORACLES = {
    "op2_sharding": SHARDING,
    "op3_line_dedup": LINE_DEDUP,
    "op4_exact_dedup": EXACT_DEDUP,
    "op7_chat_formatting": CHAT,
    "op11_merkle_manifest": MERKLE,
    "op12_importance_resampling": IMPORTANCE,
}

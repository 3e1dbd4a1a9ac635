"""SQL (DuckDB) of those registered queries that SQL can express on whole tables."""

from __future__ import annotations

from . import chat, spelling

#: CRC-32 by its table of 256 entries, made here; ``crc`` is a column of the one row of ``crc_table``.
CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)))"""


def crc32(text: str) -> str:
    codes = f"list_transform(range(0, octet_length(encode({text}))), lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


# --- reply trees


def _escaped(text: str) -> str:
    return f"replace(replace({text}, '\\', '\\\\'), '<|', '<\\|')"


_MARKS = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
_SAID = "\\### Assistant: </turn> ok"
OP4 = f"""WITH turns AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')) AS v),
t AS (SELECT conv_id, turn, role AS r, text AS x, coalesce(role, '') AS role, coalesce(text, '') AS text FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{chat.LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, x NULLS FIRST) FILTER (role = '{chat.LOSS_ROLE}'), '')) AS loss_sha256,
  CAST(sum(length({_escaped('role')}) + length({_escaped('text')}) + {_MARKS}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""

# --- archives

OP8 = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM m"""

# --- Merkle manifest


def _leaf(n_chars: str = "n_chars") -> str:
    value = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"
    return "sha256(" + " || ".join(value(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _proof(rows: str, nodes: str, same: str) -> str:
    """Siblings and sides of each row of ``rows`` (rid, pos, height), level by level."""
    return f"""(SELECT rid, list({{'h': s.h, 'odd': (x.pos >> k) & 1}} ORDER BY k) AS steps
      FROM (SELECT *, unnest(range(0, height)) AS k FROM {rows}) AS x LEFT JOIN {nodes} AS s ON {same} AND s.level = k AND s.pos = xor(x.pos >> k, 1) GROUP BY rid)"""


OP12 = f"""WITH RECURSIVE {CRC_TABLE},
l AS (SELECT row_number() OVER () AS rid, doc_id, lang, {_leaf()} AS leaf,
  CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf()} END AS found FROM documents, crc_table),
p AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
nodes AS (SELECT lang, 0 AS level, pos, n, leaf AS h FROM p UNION ALL
  SELECT lang, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
sub AS (SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (SELECT 0 AS level, pos, n, subroot AS h FROM sub UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
root AS (SELECT h AS root, level AS height FROM tops WHERE n = 1),
placed AS (SELECT p.*, subroot, sub.height, sub.pos AS upper_at FROM p JOIN sub ON p.lang IS NOT DISTINCT FROM sub.lang),
upper AS (SELECT sub.pos AS rid, sub.pos, root.height FROM sub, root),
lower_steps AS {_proof('placed', 'nodes', 's.lang IS NOT DISTINCT FROM x.lang')},
upper_steps AS {_proof('upper', 'tops', 'true')},
whole AS (SELECT placed.*, root, list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM placed LEFT JOIN lower_steps AS a USING (rid) LEFT JOIN upper_steps AS b ON b.rid = upper_at, root),
told AS (SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_filter(list_transform(steps, lambda x: x.h), lambda h: h IS NOT NULL), '')) AS proof_sha256,
  list_reduce(list_prepend({{'h': found, 'odd': CAST(0 AS BIGINT)}}, steps), lambda a, x: {{'h': CASE WHEN x.h IS NULL THEN sha256(a.h) WHEN x.odd = 1
    THEN sha256(x.h || a.h) ELSE sha256(a.h || x.h) END, 'odd': CAST(0 AS BIGINT)}}).h AS folded_root FROM whole)
SELECT *, folded_root = root AS verified FROM told"""

# --- spelling variants

_P = spelling.SpellingParams()
OP13 = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '{spelling.LETTERS}+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, '{spelling.UPPER}', '{spelling.LOWER}') AS w FROM runs WHERE length(run) >= {_P.least_length}),
h AS (SELECT w, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w")} AS h FROM low, crc_table),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM h),
words AS MATERIALIZED (SELECT word, count(*) AS n FROM cut WHERE length(word) >= {_P.least_length} GROUP BY word HAVING count(*) >= {_P.least_count}),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(0, length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM less AS a JOIN less AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less AS a JOIN words AS b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less AS a JOIN words AS b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {_P.times} * n THEN other END AS form, CASE WHEN m >= {_P.times} * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, form AS pos, 1 AS depth FROM forms WHERE form IS NOT NULL UNION ALL
  SELECT chain.word, forms.form, depth + 1 FROM chain JOIN forms ON forms.word = chain.pos WHERE forms.form IS NOT NULL),
ends AS (SELECT word, arg_max(pos, depth) AS root FROM chain GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM forms LEFT JOIN ends USING (word)"""

SQL = {"op4_chat": OP4, "op8_warc": OP8, "op12_merkle": OP12, "op13_spelling": OP13}

"""DuckDB text that gives the rows of the queries on vectors, conversations and the manifest."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text: every byte is put in, then shifted out bit by bit."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_prepend(ascii(substr({text}, i, 1)), list_transform(range(8), lambda b: -1))))"
    start = "[4294967295::BIGINT]"
    one = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::BIGINT ELSE 0 END) END"
    return f"xor(list_reduce(list_concat({start}, {steps}::BIGINT[]), lambda c, x: {one}), 4294967295::BIGINT)"


NEAR_VECTORS = """
WITH RECURSIVE e AS (
  SELECT DISTINCT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND list_sum(list_transform(embedding, lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN 1 ELSE 0 END)) = 0
    AND list_sum(list_transform(embedding, lambda x: CASE WHEN x <> 0 THEN 1 ELSE 0 END)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(v, low) AS (SELECT a, a FROM links UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.v),
lows AS (SELECT v, min(low) AS low FROM reach GROUP BY v),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
ids AS (SELECT DISTINCT vec_id FROM embeddings)
SELECT i.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, coalesce(l.low, i.vec_id) AS component_id, coalesce(coalesce(l.low, i.vec_id) = i.vec_id, true) AS kept
FROM ids i LEFT JOIN counts c ON c.a = i.vec_id LEFT JOIN lows l ON l.v = i.vec_id
"""

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _add(state: str, cost: str, letter: str, row: str = "''") -> str:
    """A state after one more edit; null if the state cannot be reached."""
    return f"CASE WHEN {state} IS NOT NULL THEN struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', r := {state}.r || {row}) END"


def _when(test: str, then: str) -> str:
    return f"CASE WHEN {test} THEN {then} END"


_KEPT = "(chr(10) || d.role || ':' || d.text)"
_USER, _ASSISTANT = "(chr(10) || 'user:' || d.text)", "(chr(10) || 'assistant:' || d.text)"
_OPEN = "d.fault NOT IN (1, 2)"
_EXTRA = "(CASE WHEN d.fault = 3 THEN 3 ELSE 0 END)"
_FROM_USER = [_add("u", "4", "D"), *[_when(f"{_OPEN} AND d.initial = 'u'", _add(s, _EXTRA, "K", _KEPT)) for s in "esa"],
              *[_when(_OPEN, _add(s, f"3 + {_EXTRA}", "R", _USER)) for s in "esa"]]
_FROM_ASSISTANT = [_add("a", "4", "D"), _when(f"{_OPEN} AND d.initial = 'a'", _add("u", _EXTRA, "K", _KEPT)), _when(_OPEN, _add("u", f"3 + {_EXTRA}", "R", _ASSISTANT))]

CONVERSATION_REPAIR = f"""
WITH RECURSIVE rows0 AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
fated AS (SELECT *, {crc32_sql("id")} % 20 AS fate FROM rows0),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM fated WHERE fate <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS initial,
    rtrim(text, {_SPACE}) AS body FROM damaged),
d AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
    WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM numbered),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 1) AS blank, count_if(fault = 2) AS duplicate,
    count_if(fault = 3) AS truncated, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM d GROUP BY conv_id),
walk(conv_id, i, e, s, u, a) AS (
  SELECT conv_id, 0::BIGINT, struct_pack(c := 0, a := '', r := ''), CAST(NULL AS STRUCT(c INTEGER, a VARCHAR, r VARCHAR)),
    struct_pack(c := 3, a := 'I', r := chr(10) || 'user:'), struct_pack(c := 6, a := 'II', r := chr(10) || 'user:' || chr(10) || 'assistant:') FROM stats
  UNION ALL
  SELECT conv_id, i, e, s, u, list_min([a, {_add("u", "3", "I", "(chr(10) || 'assistant:')")}]) FROM (
    SELECT conv_id, i, e, s, a, list_min([u, {", ".join(_add(x, "3", "I", "(chr(10) || 'user:')") for x in "esa")}]) AS u FROM (
      SELECT w.conv_id, d.i, {_add("e", "4", "D")} AS e,
        list_min([{_add("s", "4", "D")}, {_when(f"{_OPEN} AND d.initial = 's'", _add("e", _EXTRA, "K", _KEPT))}]) AS s,
        list_min([{", ".join(_FROM_USER)}]) AS u, list_min([{", ".join(_FROM_ASSISTANT)}]) AS a
      FROM walk w JOIN d ON d.conv_id IS NOT DISTINCT FROM w.conv_id AND d.i = w.i + 1))),
ends AS (SELECT s.*, list_min([w.e, w.a]) AS best FROM stats s JOIN walk w ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
  sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM ids LEFT JOIN ends ON ids.conv_id IS NOT DISTINCT FROM ends.conv_id
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


_UP = """SELECT {tree}, level + 1 AS level, place // 2 AS place, (size + 1) // 2 AS size, sha256(string_agg(digest, '' ORDER BY place)) AS digest
  FROM {nodes} WHERE size > 1 GROUP BY {tree}, level, size, place // 2"""

MANIFEST = f"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("n_chars::HUGEINT + 1")} AS other,
    coalesce({crc32_sql("coalesce(doc_id::VARCHAR, '')")} % 7 = 0 AND doc_id IS NOT NULL, false) AS changed FROM documents),
leafs AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size,
    row_number() OVER () AS row FROM hashed),
nodes(lang, level, place, size, digest) AS (
  SELECT lang, 0, place, size, leaf FROM leafs UNION ALL {_UP.format(tree="lang", nodes="nodes")}),
subs AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops(one, level, place, size, digest) AS (
  SELECT 1, 0, place, size, digest FROM subs UNION ALL {_UP.format(tree="one", nodes="tops")}),
steps AS (
  SELECT l.row, n.level, n.place AS here, s.place AS beside, s.digest FROM leafs l
  JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.size > 1 AND n.place = l.place >> n.level
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = n.level AND s.place = xor(n.place, 1)
  UNION ALL
  SELECT l.row, 1000 + n.level, n.place, s.place, s.digest FROM leafs l JOIN subs u ON u.lang IS NOT DISTINCT FROM l.lang
  JOIN tops n ON n.size > 1 AND n.place = u.place >> n.level LEFT JOIN tops s ON s.level = n.level AND s.place = xor(n.place, 1)),
paths AS (
  SELECT row, coalesce(string_agg(digest, '' ORDER BY level), '') AS siblings,
    list(CASE WHEN digest IS NULL THEN 'N' WHEN beside < here THEN 'L' || digest ELSE 'R' || digest END ORDER BY level) AS path FROM steps GROUP BY row),
folded AS (
  SELECT l.*, u.digest AS subroot, (SELECT digest FROM tops WHERE size = 1) AS root, sha256(coalesce(siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(CASE WHEN changed THEN other ELSE leaf END, coalesce(path, [])),
      lambda x, y: sha256(CASE y[1] WHEN 'N' THEN x WHEN 'L' THEN substr(y, 2) || x ELSE x || substr(y, 2) END)) AS folded_root
  FROM leafs l JOIN subs u ON u.lang IS NOT DISTINCT FROM l.lang LEFT JOIN paths p ON p.row = l.row)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

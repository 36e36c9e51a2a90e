"""DuckDB SQL for the queries on conversations and phrases."""

from __future__ import annotations

from functools import reduce

from . import chat


def _crc_table() -> list[int]:
    """The 256 steps of CRC-32 (polynomial 0xEDB88320, reflected)."""
    return [reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), byte) for byte in range(256)]


def crc32(text: str) -> str:
    """SQL for the CRC-32 of an expression's ASCII text."""
    characters = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(unicode(substr({text}, i, 1)) AS BIGINT))"
    step = f"lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {characters}), {step}), 4294967295::BIGINT)"


def _then(weight: str, cost: str, label: str) -> str:
    """A weight, eight digits of cost and then the labels, with an arc appended."""
    return f"printf('%08d', CAST(left({weight}, 8) AS INT) + {cost}) || substr({weight}, 9) || {label}"


def _inserted(c: str) -> tuple[str, str, str, str]:
    """The weights of the four grammar states once insertions have been tried."""
    user = f"least({c}.wu, {_then(f'{c}.wz', '2', chr(39) + 'I' + chr(39))}, {_then(f'{c}.ws', '2', chr(39) + 'I' + chr(39))}, {_then(f'{c}.wa', '2', chr(39) + 'I' + chr(39))})"
    return f"{c}.wz", f"{c}.ws", user, f"least({c}.wa, {_then(user, '2', chr(39) + 'I' + chr(39))})"


_KEY = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
_ROLE = lambda r: f"CASE WHEN sym <> 'x' THEN {_then('{w}', f'late + CASE WHEN ini = {r!r} THEN 0 ELSE 2 END', f'CASE WHEN ini = {r!r} THEN {chr(39)}K{chr(39)} ELSE {chr(39)}R{chr(39)} END')} END"
_DELETED = lambda w: _then(w, "3", "'D'")


def _to(role: str, weight: str) -> str:
    return _ROLE(role).replace("{w}", weight)


_Z, _S, _U, _A = _inserted("p")
REPAIR = rf"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(_KEY)} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM b WHERE kind <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS ini, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS late, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
r AS (SELECT conv_id, role, text, i, ini, CASE WHEN blank OR again THEN 'x' ELSE ini END AS sym, CASE WHEN late THEN 1 ELSE 0 END AS late FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
             count(*) FILTER (late AND NOT again AND NOT blank) AS truncated, count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
-- the least weight of each grammar state (z start, s, u, a) after i rows
p AS (SELECT conv_id, 0::BIGINT AS i, '00000000' AS wz, NULL::VARCHAR AS ws, NULL::VARCHAR AS wu, NULL::VARCHAR AS wa FROM c
      UNION ALL
      SELECT p.conv_id, r.i, {_DELETED(_Z)}, least({_DELETED(_S)}, CASE WHEN sym <> 'x' AND ini = 's' THEN {_then(_Z, 'late', "'K'")} END),
             least({_DELETED(_U)}, {_to('u', _Z)}, {_to('u', _S)}, {_to('u', _A)}), least({_DELETED(_A)}, {_to('a', _U)})
      FROM p JOIN r ON p.conv_id = r.conv_id AND r.i = p.i + 1),
w AS (SELECT c.*, least({_Z}, {_A}) AS w FROM p JOIN c ON p.conv_id = c.conv_id AND p.i = c.n),
x AS (SELECT conv_id, 0::BIGINT AS step, 0::BIGINT AS i, 'z' AS state, '' AS said FROM w
      UNION ALL
      SELECT x.conv_id, x.step + 1, x.i + CASE WHEN e.e = 'I' THEN 0 ELSE 1 END,
             CASE e.e WHEN 'D' THEN state WHEN 'K' THEN r.ini ELSE CASE WHEN state = 'u' THEN 'a' ELSE 'u' END END,
             said || CASE WHEN e.e = 'D' THEN '' ELSE CASE WHEN said = '' THEN '' ELSE chr(10) END
                       || CASE WHEN e.e = 'K' THEN r.role WHEN state = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e.e = 'I' THEN '' ELSE r.text END END
      FROM x JOIN (SELECT conv_id, unnest(string_split(substr(w, 9), '')) AS e, generate_subscripts(string_split(substr(w, 9), ''), 1) AS step FROM w) e ON x.conv_id = e.conv_id AND e.step = x.step + 1
             LEFT JOIN r ON r.conv_id = x.conv_id AND r.i = x.i + 1),
s AS (SELECT conv_id, arg_max(said, step) AS said FROM x GROUP BY conv_id)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(left(w, 8), '0') AS BIGINT) AS cost, coalesce(substr(w, 9), '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN w ON k.conv_id = w.conv_id LEFT JOIN s ON k.conv_id = s.conv_id
"""

_ESCAPED = lambda c: f"regexp_replace({c}, '<(\\\\*)\\|', '<\\\\\\1|', 'g')"
CHAT = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, t.turn, t.role, '{chat.HOSTILE}' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)),
r AS (SELECT *, row_number() OVER o AS i, lag(role) OVER o IS DISTINCT FROM role AS opens FROM c WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_ESCAPED('text')}) + CASE WHEN opens THEN {len(chat.START)} + length(replace(replace({_ESCAPED('role')}, '%', '%25'), chr(10), '%0A')) + 1 + {len(chat.END)} ELSE {len(chat.SEPARATOR)} END) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""

COLLOCATIONS = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, w[i:i + k - 1] AS p, k, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) s(k) WHERE len(w) >= k) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, p, k AS size, f AS a, unnest(range(1, k)) AS k FROM g WHERE k >= 2),
s AS (SELECT c.lang, c.p, size, a, c.k, l.f AS l, r.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
      FROM c JOIN g l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN g r ON r.lang = c.lang AND r.p = c.p[c.k + 1:] JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (SELECT DISTINCT lang, p[i:j] AS p, a FROM (SELECT lang, p, size, a, i, unnest(range(i + 1, size + 1)) AS j FROM (SELECT lang, p, size, a, unnest(range(1, size)) AS i FROM b WHERE size > 2)) WHERE j - i + 1 < size),
kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM inner_parts x WHERE x.lang = b.lang AND x.p = b.p AND 100 * x.a >= 100 * b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank, array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM kept QUALIFY rank <= 2000
"""

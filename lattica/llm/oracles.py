"""DuckDB SQL of those operators whose tables and rows SQL can say whole."""

from __future__ import annotations


def _crc32(x: str) -> str:
    """The crc32 of an ASCII text: a fold over its bytes, of eight shifts each (the polynomial's reversed form)."""
    shift = "lambda s, t: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END"
    byte = f"lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], {shift})"
    return f"xor(4294967295, list_reduce(list_transform(range(1, len({x}) + 1), lambda p: CAST(ascii(substr({x}, p, 1)) AS BIGINT)), {byte}, CAST(4294967295 AS BIGINT)))"


def _way(cost: str, audit: str, text: str) -> str:
    return f"{{'c': CAST({cost} AS BIGINT), 'k': {audit}, 't': {text}}}"


def _with(way: str, cost: str, letter: str, line: str | None) -> str:
    return _way(f"{way}.c + {cost}", f"{way}.k || {letter}", f"{way}.t" if line is None else f"{way}.t || chr(10) || {line}")


def _inserted(end: str, *ways: str) -> str:
    """The least of ways to a state: as it is, or after one more turn from another."""
    role = {"u": "'user:'", "a": "'assistant:'"}[end]
    return f"""least({end}0, {", ".join(_with(w, "3", "'I'", role) for w in ways)})"""


_NEVER = 1 << 50
_STAY = "CASE WHEN fault IN ('blank', 'duplicate') THEN {never} ELSE 0 END + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END + CASE WHEN initial = '{x}' THEN 0 ELSE 3 END"


def _kept(way: str, x: str, name: str) -> str:
    keep = f"initial = '{x}'"
    return _with(way, _STAY.format(never=_NEVER, x=x), f"CASE WHEN {keep} THEN 'K' ELSE 'R' END", f"CASE WHEN {keep} THEN role ELSE '{name}' END || ':' || text")


def _gone(way: str) -> str:
    return _with(way, "4", "'D'", None)


# Inserted turns first: an assistant's may follow an inserted user's, so ways to the user's turn come before.
def _closed(rows: str) -> str:
    return f"SELECT *, {_inserted('a', 'u1')} AS a1 FROM (SELECT *, {_inserted('u', 'e0', 's0', 'a0')} AS u1 FROM ({rows}))"


_NONE = _way(str(_NEVER), "''", "''")
_SYSTEM = _with("e0", f"CASE WHEN fault IN ('blank', 'duplicate') OR initial <> 's' THEN {_NEVER} ELSE 0 END + CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END", "'K'", "role || ':' || text")

OP11 = rf"""
WITH RECURSIVE hit AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), struck AS (
    SELECT *, {_crc32("name")} % 20 AS h FROM hit
), damaged AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM struck WHERE h <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p,
        regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, substr(role, 1, 1) AS initial
    FROM damaged
), rows_ AS (
    SELECT conv_id, p, turn, role, text, initial, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY p) || initial AS pair
    FROM placed
), ways AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS p, {_way("0", "''", "''")} AS e0, {_NONE} AS s0, {_NONE} AS u0, {_NONE} AS a0 FROM rows_
    UNION ALL
    SELECT conv_id, p, {_gone("e0")}, least({_gone("s0")}, {_SYSTEM}), least({_gone("u1")}, {_kept("least(e0, s0, a1)", "u", "user")}), least({_gone("a1")}, {_kept("u1", "a", "assistant")})
    FROM ({_closed("SELECT r.*, w.e0, w.s0, w.u0, w.a0 FROM ways w JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.p = w.p + 1")})
), ended AS (
    SELECT conv_id, least(e0, a1) AS best FROM ({_closed("SELECT * FROM ways QUALIFY p = max(p) OVER (PARTITION BY conv_id)")})
), counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
        count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM rows_ GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(best.c, 0) AS cost, coalesce(best.k, '') AS audit, sha256(coalesce(substr(best.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended d ON d.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def _field(x: str) -> str:
    return f"coalesce(CAST(strlen(CAST({x} AS VARCHAR)) AS VARCHAR) || ':' || CAST({x} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEVEL = "SELECT tree, level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), (n + 7) // 8 FROM {nodes} WHERE n > 1 GROUP BY tree, level, i // 8, n"

OP12 = f"""
WITH RECURSIVE named AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS tree, {_leaf("text")} AS leaf,
        CASE WHEN doc_id IS NOT NULL AND text IS NOT NULL AND {_crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_leaf(_LOWER)} END AS tampered
    FROM documents
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM named
), low AS (
    SELECT tree, CAST(0 AS BIGINT) AS level, CAST(i AS BIGINT) AS i, leaf AS digest, CAST(n AS BIGINT) AS n FROM leaves UNION ALL {_LEVEL.format(nodes="low")}
), subroots AS (
    SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
    SELECT '' AS tree, CAST(0 AS BIGINT) AS level, CAST(i AS BIGINT) AS i, digest, CAST(n AS BIGINT) AS n FROM subroots UNION ALL {_LEVEL.format(nodes="high")}
), places AS (
    SELECT r, tree, i, 0 AS stage FROM leaves UNION ALL SELECT l.r, '', s.i, 1 FROM leaves l JOIN subroots s USING (tree)
), nodes AS (
    SELECT *, 0 AS stage FROM low UNION ALL SELECT *, 1 FROM high
), steps AS (
    SELECT r, row_number() OVER (PARTITION BY r ORDER BY stage, level) AS k, before, after FROM (
        SELECT p.r, p.stage, n.level, coalesce(string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i < p.i >> (3 * n.level)), '') AS before,
            coalesce(string_agg(n.digest, '' ORDER BY n.i) FILTER (n.i > p.i >> (3 * n.level)), '') AS after
        FROM places p JOIN nodes n ON n.stage = p.stage AND n.tree = p.tree AND n.n > 1 AND n.i // 8 = p.i >> (3 * n.level + 3) GROUP BY 1, 2, 3)
), folded AS (
    SELECT r, CAST(0 AS BIGINT) AS k, coalesce(tampered, leaf) AS x FROM leaves UNION ALL SELECT f.r, s.k, sha256(s.before || f.x || s.after) FROM folded f JOIN steps s ON s.r = f.r AND s.k = f.k + 1
), ends AS (
    SELECT r, max_by(x, k) AS x FROM folded GROUP BY r
), proofs AS (
    SELECT r, sha256(string_agg(before || after, '' ORDER BY k)) AS proof FROM steps GROUP BY r
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, t.digest AS root, coalesce(p.proof, sha256('')) AS proof_sha256, e.x AS folded_root, e.x = t.digest AS verified
FROM leaves l JOIN subroots s USING (tree) JOIN ends e ON e.r = l.r LEFT JOIN proofs p ON p.r = l.r CROSS JOIN (SELECT digest FROM high WHERE n = 1) t
"""


def _escaped(x: str) -> str:
    return rf"replace(replace({x}, '\', '\\'), '<|', '<\|')"


#: Windows of 512 tokens of four characters: turns that begin within the same 256 are new in one window; a later one repeats the
#: system turn, and the turn before it if that has at most 128.
OP2 = rf"""
WITH chats AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok'
), formed AS (
    SELECT *, '<|turn|>' || {_escaped("role")} || '<|says|>' || {_escaped("text")} || '<|end|>' AS form,
        row_number() OVER (PARTITION BY conv_id ORDER BY floor(coalesce(turn, -1) / 256), turn NULLS FIRST, role, text) AS place
    FROM chats
), sized AS (
    SELECT *, CAST(ceil(length(form) / 4.0) AS BIGINT) AS tokens, place = 1 AND role = 'system' AS is_system FROM formed
), summed AS (
    SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY place) AS upto, sum(tokens) OVER (PARTITION BY conv_id) AS total FROM sized
), windowed AS (
    SELECT *, (upto - tokens) // 256 AS own, upto // 256 > (upto - tokens) // 256 AND tokens <= 128 AND NOT is_system AND upto < total AS is_tail FROM summed
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(form)) + coalesce(sum(length(form)) FILTER (is_tail), 0) + coalesce(max(length(form)) FILTER (is_system), 0) * count(DISTINCT own) FILTER (own > 0) AS BIGINT) AS formatted_chars,
    count(DISTINCT own) AS n_windows
FROM windowed GROUP BY conv_id
"""

"""SQL for the conversation queries: CRC-32 by table, the repair as a fold over a conversation's rows, the trie of whole paths."""

from __future__ import annotations

CRC = """crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
)"""


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text; needs the table CRC."""
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _add(way: str, cost: int | str, letter: str, line: str | None = None) -> str:
    lines = f"{way}.t" if line is None else f"list_append({way}.t, {line})"
    return f"CASE WHEN {way} IS NOT NULL THEN struct_pack(c := {way}.c + {cost}, a := {way}.a || '{letter}', t := {lines}) END"


def _best(*ways: str) -> str:
    return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"


def _then(states: str, body: str) -> str:
    """``body`` with z for ``states``."""
    return f"list_transform([{states}], lambda z: {body})[1]"


def _inserted(z: str) -> str:
    """The best way to each state (nothing, system, user, assistant) with one more inserted turn."""
    user = (_add(f"{z}[{k}]", 3, "I", "'user:'") for k in (1, 2, 4))
    return f"[{z}[1], {z}[2], {_best(f'{z}[3]', *user)}, {_best(f'{z}[4]', _add(f'{z}[3]', 3, 'I', chr(39) + 'assistant:' + chr(39)))}]"


def _keep(state: int, initial: str) -> str:
    return f"CASE WHEN row.k = '{initial}' THEN {_add(f'z[{state}]', 'row.cut', 'K', 'row.line')} END"


def _rerole(state: int, role: str) -> str:
    return f"CASE WHEN NOT row.gone THEN {_add(f'z[{state}]', '3 + row.cut', 'R', f'{chr(39)}{role}:{chr(39)} || row.text')} END"


def _delete(state: int) -> str:
    return _add(f"z[{state}]", 4, "D")


_USER = _best(_delete(3), *(way for k in (1, 2, 4) for way in (_keep(k, "u"), _rerole(k, "user"))))
_ROW = f"[{_delete(1)}, {_best(_delete(2), _keep(1, 's'))}, {_USER}, {_best(_delete(4), _keep(3, 'a'), _rerole(3, 'assistant'))}]"
_STEP = _then(_inserted("acc.s"), _ROW)
_END = _then(_then(_inserted("acc.s"), _inserted("z")), _best("z[1]", "z[4]"))
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_NOTHING = "struct_pack(s := [struct_pack(c := 0, a := '', t := []::VARCHAR[]), NULL, NULL, NULL], k := NULL::VARCHAR, gone := false, cut := 0, line := '', text := '')"
_KIND = crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")

REPAIR = f"""
WITH {CRC}, hurt AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_KIND} % 20 AS kind FROM conversations, crc)
), placed AS (
    SELECT *, row_number() OVER w AS place, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, lag(role) OVER w AS before, rtrim(text, {_BLANKS}) AS solid
    FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), marked AS (
    SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM placed
), convs AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (place > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal,
        list(struct_pack(s := []::STRUCT(c INTEGER, a VARCHAR, t VARCHAR[])[], k := CASE WHEN fault NOT IN ('blank', 'duplicate') THEN left(role, 1) END, gone := fault IN ('blank', 'duplicate'), cut := CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, line := role || ':' || text, text := text) ORDER BY place) AS rows
    FROM marked GROUP BY conv_id
), repaired AS (
    SELECT * EXCLUDE (rows), list_transform([list_reduce(list_prepend({_NOTHING}, rows), lambda acc, row: struct_pack(s := {_STEP}, k := row.k, gone := row.gone, cut := row.cut, line := row.line, text := row.text))], lambda acc: {_END})[1] AS e FROM convs
)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(e.c, 0)::BIGINT AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(array_to_string(e.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN repaired r ON i.conv_id IS NOT DISTINCT FROM r.conv_id
"""

TRIE = f"""
WITH {CRC}, own AS (
    SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), headed AS (
    SELECT own.*, {crc32("conv_id::VARCHAR")} % 6 AS h FROM own, crc
), rebuilt AS (
    SELECT a.conv_id, list_concat(coalesce(b.turns[1:h], []), a.turns[h + 1:]) AS path FROM headed a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), prefixes AS (
    SELECT conv_id, d, path[1:d] AS p, d = len(path) AS ends FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM rebuilt)
), nodes AS (
    SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ids FROM prefixes GROUP BY d, p
), linked AS (
    SELECT c.*, a.conv_id AS parent FROM nodes c LEFT JOIN nodes a ON a.d = c.d - 1 AND a.p = c.p[1:c.d - 1]
), kids AS (
    SELECT d - 1 AS d, parent AS conv_id, count(*) AS kids FROM linked WHERE d > 0 GROUP BY ALL
), sums AS (
    SELECT d, p, conv_id, CASE WHEN kids IS NULL THEN 1 ELSE 0 END AS leaf, (n - 1) * coalesce(length(p[d].x), 0) AS saved FROM nodes LEFT JOIN kids USING (d, conv_id)
), below AS (
    SELECT k AS d, p[1:k] AS p, sum(leaf)::BIGINT AS leaves, sum(saved)::BIGINT AS saved FROM (SELECT *, unnest(range(d + 1)) AS k FROM sums) GROUP BY ALL
)
SELECT conv_id, d AS depth, parent AS parent_conv_id, n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(ids) AS ends_sha256
FROM linked JOIN below USING (d, p) LEFT JOIN kids USING (d, conv_id)
"""

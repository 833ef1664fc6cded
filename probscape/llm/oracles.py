"""DuckDB SQL of queries whose calculation takes more than a statement or two."""

from __future__ import annotations

from probscape.llm.merkle import ARITY

#: The table of the crc32 polynomial, from its rule, as one row with the list ``t``.
CRC_TABLE = """crc_table AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) AS r(i))"""


def crc32(text: str) -> str:
    """Unsigned crc32 of a text of ASCII characters, byte by byte; the query joins ``crc_table``."""
    codes = f"list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT))"
    return f"xor(list_reduce({codes}, lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


#: Levels of sixteen children that the SQL of the manifest writes out.
_LEVELS = 6
_OPEN = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
_CLOSE = "ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING"


def _tree(name: str, base: str) -> str:
    """CTEs ``<name>0`` to ``<name>_LEVELS``: nodes (g, pos, h) with their number n in the tree and their siblings."""
    run = f"PARTITION BY g, pos // {ARITY} ORDER BY pos"
    out = []
    for k in range(_LEVELS + 1):
        source = base if k == 0 else (
            f"(SELECT g, pos // {ARITY} AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h "
            f"FROM {name}{k - 1} GROUP BY g, pos // {ARITY})")
        out.append(
            f"{name}{k} AS MATERIALIZED (SELECT g, pos, h, count(*) OVER (PARTITION BY g) AS n, coalesce(string_agg(h, '') OVER ({run} {_OPEN}), '') AS l, "
            f"coalesce(string_agg(h, '') OVER ({run} {_CLOSE}), '') AS r FROM {source})")
    return ", ".join(out)


def _climb(name: str, rows: str, start: str, at: str, prefix: str) -> str:
    """CTEs that fold ``start`` of ``rows`` up a tree and gather the siblings: ``f`` and ``w`` in ``<prefix>_LEVELS``."""
    out = []
    for k in range(_LEVELS):
        source = f"(SELECT *, {start} AS f, w0 AS w FROM {rows})" if k == 0 else f"{prefix}{k}"
        out.append(
            f"{prefix}{k + 1} AS (SELECT a.* REPLACE (CASE WHEN t.n > 1 THEN sha256(t.l || a.f || t.r) ELSE a.f END AS f, a.w || t.l || t.r AS w) "
            f"FROM {source} a JOIN {name}{k} t ON t.g = a.g AND t.pos = a.{at} // {ARITY**k})")
    return ", ".join(out)


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return f"sha256({_field('doc_id::VARCHAR')} || {_field('source')} || {_field('lang')} || {_field('n_chars::VARCHAR')} || {_field(text)})"


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MERKLE = f"""
WITH {CRC_TABLE},
     named AS (SELECT * EXCLUDE (t), coalesce('s' || source, '') AS g, {crc32("doc_id::VARCHAR")} % 5 IS NOT DISTINCT FROM 0 AS tampered FROM documents, crc_table),
     leaves AS (SELECT doc_id, g, {_leaf("text")} AS leaf, CASE WHEN tampered THEN {_leaf(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed FROM named),
     placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, '' AS w0 FROM leaves),
     {_tree("s", "(SELECT g, pos, leaf AS h FROM placed)")},
     tops AS (SELECT g AS source, row_number() OVER (ORDER BY g) - 1 AS top, h AS subroot FROM s{_LEVELS}),
     {_tree("c", "(SELECT 0 AS g, top AS pos, subroot AS h FROM tops)")},
     {_climb("s", "placed", "coalesce(changed, leaf)", "pos", "up")},
     inner_rows AS (SELECT u.* EXCLUDE (g, f, w, w0), 0 AS g, top, subroot, f AS f0, w AS w0 FROM up{_LEVELS} u JOIN tops ON tops.source = u.g),
     {_climb("c", "inner_rows", "f0", "top", "over")}
SELECT doc_id, leaf, subroot, h AS root, sha256(w) AS proof_sha256, f AS folded_root, f = h AS verified
FROM over{_LEVELS} a, (SELECT h FROM c{_LEVELS}) AS r
"""

_BARE = r"[^\x20\x09-\x0D]"

CONVERSATIONS = rf"""
WITH RECURSIVE {CRC_TABLE},
     drawn AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                      {crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations, crc_table),
     damaged AS (SELECT g, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
                 FROM drawn, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS copies(i)),
     placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged),
     judged AS (SELECT *, role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY g ORDER BY k) AS before,
                       CASE WHEN NOT regexp_matches(text, '{_BARE}') THEN 'blank'
                            WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY k) > 1 THEN 'duplicate'
                            WHEN regexp_extract(text, '({_BARE})[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
     edits AS (SELECT g, k, 4 AS cost, 'D' AS letter, NULL AS made, text FROM judged
               UNION ALL SELECT g, k, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, 'K', role, text FROM judged WHERE fault IN ('', 'truncated')
               UNION ALL SELECT g, k, CASE fault WHEN 'truncated' THEN 6 ELSE 3 END, 'R', made, text FROM judged, (VALUES ('user'), ('assistant')) AS r(made)
                         WHERE fault IN ('', 'truncated')),
     steps (before, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
     gaps_filled (before, after, cost, letters, made) AS (VALUES
         (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']),
         (2, 3, 3, 'I', ['assistant:']), (3, 2, 3, 'I', ['user:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:']),
         (2, 2, 6, 'II', ['assistant:', 'user:']), (3, 3, 6, 'II', ['user:', 'assistant:'])),
     best AS (
         SELECT g, 0::BIGINT AS k, after AS state, cost, letters AS audit, made AS done FROM (SELECT DISTINCT g FROM drawn), gaps_filled WHERE before = 0
         UNION ALL
         SELECT g, k, state, cost, audit, done FROM (
             SELECT b.g, e.k, f.after AS state, b.cost + e.cost + f.cost AS cost, b.audit || e.letter || f.letters AS audit,
                    list_concat(b.done, CASE WHEN e.made IS NULL THEN [] ELSE [e.made || ':' || e.text] END, f.made) AS done,
                    row_number() OVER (PARTITION BY b.g, f.after ORDER BY b.cost + e.cost + f.cost, b.audit || e.letter || f.letters) AS place
             FROM best b JOIN edits e ON e.g = b.g AND e.k = b.k + 1 LEFT JOIN steps s ON s.before = b.state AND s.initial = e.made[1:1]
                  JOIN gaps_filled f ON f.before = CASE WHEN e.made IS NULL THEN b.state ELSE s.after END)
         WHERE place = 1),
     counts AS (SELECT conv_id, d.g, coalesce(max(j.turn) - min(j.turn) + 1 - count(DISTINCT j.turn), 0) AS gaps, count_if(fault = 'blank')::BIGINT AS blank, count_if(fault = 'duplicate')::BIGINT AS duplicate,
                       count_if(fault = 'truncated')::BIGINT AS truncated, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, count(k) AS n
                FROM (SELECT DISTINCT conv_id, g FROM drawn) d LEFT JOIN judged j ON j.g = d.g GROUP BY conv_id, d.g)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, arg_min(cost, (cost, audit))::BIGINT AS cost, arg_min(audit, (cost, audit)) AS audit,
       sha256(array_to_string(arg_min(done, (cost, audit)), chr(10))) AS repaired_sha256
FROM counts JOIN best ON best.g = counts.g AND best.k = counts.n WHERE state IN (0, 3) GROUP BY ALL
"""

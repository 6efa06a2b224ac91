"""DuckDB statements of the subpackage's queries, where SQL can express them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), '{UPPER}', '{LOWER}') AS k
  FROM lines),
shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
flagged AS (
  SELECT keyed.*, coalesce(keyed.doc_id > shared.first, false) AS gone FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""


OP2 = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, i + j AS p FROM win JOIN firsts USING (k), range(13) AS r(j) WHERE doc_id > first),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (
  SELECT doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS kept
  FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

OP4 = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(b) AS component_id
FROM reach LEFT JOIN sizes ON sizes.doc_id = a GROUP BY a
"""

OP8 = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(ws) >= n)),
found AS (SELECT doc_id, item_id, n, i FROM doc_windows JOIN item_windows USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, range(10) AS r(j) WHERE j < n GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_WORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
# kind, pattern, group whose length counts, its least length
_SECRETS = [
    ("assign", _WORD + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]+", 0, 32),
    ("pem", "-----BEGIN ([A-Z0-9]{1,16} ){0,3}PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", 0, 1),
]


def _secret(nth: int) -> str:
    """Matches of one kind: places from the lengths of the pieces between them."""
    kind, pattern, group, least = _SECRETS[nth]
    return f"""
  SELECT doc_id, {nth} AS nth, '{kind}' AS kind, g, list_sum(p[1:i]) + coalesce(list_sum(m[1:i - 1]), 0) AS start, m[i] AS size FROM (
    SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, unnest(g) AS g, m, p FROM (
      SELECT doc_id, list_transform(regexp_extract_all(t, '{pattern}', 0), lambda x: length(x)) AS m,
             list_transform(regexp_extract_all(t, '{pattern}', {group}), lambda x: length(x)) AS g,
             list_transform(string_split_regex(t, '{pattern}'), lambda x: length(x)) AS p FROM d))
  WHERE g >= {least}"""


OP11 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(_secret(k) for k in range(len(_SECRETS)))}),
named AS (SELECT *, kind || ':' || start || ':' || (start + size) AS span FROM spans),
found AS (
  SELECT doc_id, count(*) FILTER (nth = 0) AS n_assign, count(*) FILTER (nth = 1) AS n_access, count(*) FILTER (nth = 2) AS n_hex,
         string_agg(span, ',' ORDER BY start, nth) FILTER (nth < 3) AS base, string_agg(span, ',' ORDER BY start, nth) AS spans
  FROM named GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found USING (doc_id)
"""


def _plus(value: str, cost: str, letter: str) -> str:
    """A value is nine digits of cost and the audit; its order is that of text."""
    return f"(lpad(CAST(CAST({value}[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || {value}[10:] || '{letter}')"


def _insert(a: str) -> dict[int, str]:
    """States behind the insertions that may stand before a turn."""
    user = f"least({a}.s2, {_plus(f'{a}.s0', '5', 'I')}, {_plus(f'{a}.s1', '5', 'I')}, {_plus(f'{a}.s3', '5', 'I')})"
    return {0: f"{a}.s0", 1: f"{a}.s1", 2: user, 3: f"least({a}.s3, {_plus(user, '5', 'I')})"}


def _step() -> str:
    own = {k: f"a.t{k}" for k in range(4)}
    more = "CASE x.fault WHEN 1 THEN 5 ELSE 0 END"
    keep = lambda kind, k: f"CASE WHEN x.kind = {kind} AND x.fault < 2 THEN {_plus(own[k], more, 'K')} END"
    role = lambda k: f"CASE WHEN x.fault < 2 THEN {_plus(own[k], f'1 + {more}', 'R')} END"
    out = {k: [_plus(own[k], "2", "D")] for k in range(4)}
    out[1].append(keep(0, 0))
    out[2] += [f(k) for k in (0, 1, 3) for f in (lambda k: keep(1, k), role)]
    out[3] += [keep(2, 2), role(2)]
    s = {k: f"least({', '.join(v)})" for k, v in out.items()}
    return ", ".join(f"s{k} := {v}" for k, v in s.items())


_EMPTY = "struct_pack({}, kind := 0, fault := 0, turn := false)".format(
    ", ".join([f"{c}{k} := " + ("'000000000'" if (c, k) == ("s", 0) else "CAST(NULL AS VARCHAR)") for c in "st" for k in range(4)]))
# two elements per turn: one inserts before it, one edits it
_REDUCE = f"""list_reduce(steps, lambda a, x: CASE WHEN x.turn
  THEN struct_pack({_step()}, {", ".join(f"t{k} := a.t{k}" for k in range(4))}, kind := x.kind, fault := x.fault, turn := x.turn)
  ELSE struct_pack({", ".join(f"s{k} := a.s{k}" for k in range(4))}, {", ".join(f"t{k} := {v}" for k, v in _insert("a").items())},
                   kind := x.kind, fault := x.fault, turn := x.turn) END, {_EMPTY})"""
_BLANK = "[\\x20\\x09-\\x0D]"

OP13 = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
crc AS (
  SELECT key, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length(key) + 1), lambda i: CAST(ascii(key[i]) AS BIGINT))),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END)) AS r
  FROM (SELECT DISTINCT key FROM c)),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM (SELECT c.*, xor(r, 4294967295) % 20 AS kind FROM c JOIN crc USING (key)) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS n FROM damaged),
looked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
         regexp_replace(text, '{_BLANK}+$', '') AS body,
         CASE role[1] WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS kind,
         lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) || role[1] AS pair FROM placed),
faulted AS (
  SELECT *, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM looked),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
         list(struct_pack(kind := kind, fault := CASE fault WHEN 'truncated' THEN 1 WHEN 'blank' THEN 2 WHEN 'duplicate' THEN 2 ELSE 0 END) ORDER BY n) AS turns
  FROM faulted GROUP BY conv_id),
stepped AS (
  SELECT * EXCLUDE (turns), list_transform(range(0, 2 * len(turns) + 1), lambda i: struct_pack(
    {", ".join(f"{c}{k} := CAST(NULL AS VARCHAR)" for c in "st" for k in range(4))},
    kind := coalesce(turns[i // 2 + 1].kind, 0), fault := coalesce(turns[i // 2 + 1].fault, 0), turn := i % 2 = 1)) AS steps FROM told),
solved AS (SELECT * EXCLUDE (steps, v), least(v.t0, v.t3) AS v FROM (SELECT *, {_REDUCE} AS v FROM stepped)),
letters AS (
  SELECT conv_id, unnest(range(1, length(v) - 8)) AS i, unnest(string_split(v[10:], '')) AS letter FROM solved WHERE length(v) > 9),
edits AS (SELECT *, sum(CASE letter WHEN 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY i) AS n FROM letters),
stay AS (
  SELECT e.conv_id, e.i, e.letter, f.role, coalesce(f.text, '') AS text,
         row_number() OVER (PARTITION BY e.conv_id ORDER BY e.i) - 1 AS k,
         first_value(CASE WHEN e.letter = 'K' AND f.kind = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv_id ORDER BY e.i) AS s
  FROM edits e LEFT JOIN faulted f ON e.letter <> 'I' AND f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.n = e.n WHERE e.letter <> 'D'),
lines AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS body
  FROM stay GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(CAST(v[1:9] AS BIGINT), 0) AS cost, coalesce(v[10:], '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN solved ON solved.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN lines ON lines.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def statements() -> dict[str, str]:
    return {"op2_substring_dedup": OP2, "op4_jaccard_join": OP4, "op7_line_dedup": OP7, "op8_decontamination": OP8,
            "op11_secret_scans": OP11, "op13_conversation_repair": OP13}

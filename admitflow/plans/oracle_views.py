"""DuckDB statements of the derived fixture views, as CTE bodies.

``with_views(sql, *names)`` prefixes a query with the CTEs it needs (and
their dependencies, in order). These are the independent statements the
driver's oracle compares our Spark plans against.
"""

from __future__ import annotations

# Python's Unicode whitespace and "word" classes for RE2 (fixed values; the
# same classes as admitflow.functions.text).
WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"\p{L}\p{N}_"
STOP = "['the','and','is','in','to','a','for','of','on','with','at','by','as','an','it']"

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, deps: list[str], body: str) -> None:
    VIEWS[name] = (deps, body)


_SPLIT = ("CASE WHEN o_orderkey % 10 < 7 THEN 'train' WHEN o_orderkey % 10 < 9 THEN 'valid' "
          "ELSE 'test' END")
_ID = "CAST(o_custkey AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR)"

_view("cohort", [], f"""
SELECT {_ID} AS id, CAST(o_custkey AS VARCHAR) AS subject,
       CASE WHEN date_diff('day', CAST(o_orderdate AS DATE),
                 CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE)) <= 30
            THEN 1 ELSE 0 END AS label,
       {_SPLIT} AS split, o_orderkey AS row_ix
FROM orders""")

_view("order_ids", [], f"SELECT o_orderkey, {_ID} AS id, {_SPLIT} AS split FROM orders")

_view("label_rows", ["order_ids"], """
SELECT o.id, CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END AS label, o.split,
       l.l_orderkey * 100 + l.l_linenumber AS row_ix
FROM lineitem l JOIN order_ids o ON l.l_orderkey = o.o_orderkey""")

_view("day_rows", ["order_ids"], """
SELECT o.id, d.day, CAST(row_number() OVER (PARTITION BY o.id ORDER BY d.day) - 1 AS INTEGER) AS day_idx,
       d.features
FROM (SELECT l_orderkey, CAST(l_shipdate AS DATE) AS day,
             [sum(l_quantity), sum(l_extendedprice), avg(l_discount), avg(l_tax), CAST(count(*) AS DOUBLE),
              sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END),
              sum(CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END),
              sum(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END)] AS features
      FROM lineitem GROUP BY l_orderkey, CAST(l_shipdate AS DATE)) d
JOIN order_ids o ON d.l_orderkey = o.o_orderkey""")

# day_rows_64 in long form: one row per (id, day, feature position).
_view("day_rows_64_long", ["order_ids"], """
SELECT o.id, e.day, CAST(dense_rank() OVER (PARTITION BY o.id ORDER BY e.day) - 1 AS INTEGER) AS day_idx,
       e.pos, e.value
FROM (SELECT l.l_orderkey, CAST(l.l_shipdate AS DATE) AS day, u.pos, avg(u.v) AS value
      FROM lineitem l
      JOIN (SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS pos,
                   CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) u
        ON u.vec_id = l.l_partkey % (SELECT count(*) FROM embeddings)
      GROUP BY l.l_orderkey, CAST(l.l_shipdate AS DATE), u.pos) e
JOIN order_ids o ON e.l_orderkey = o.o_orderkey""")

_view("notes", [], """
SELECT CAST(o.o_custkey AS VARCHAR) || '_' || CAST(o.o_orderkey AS VARCHAR) AS note_id,
       CAST(o.o_custkey AS VARCHAR) AS subject, CAST(o.o_orderkey AS VARCHAR) AS hadm,
       CAST(row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS INTEGER) AS note_seq,
       d.text, o.o_orderkey AS row_ix
FROM orders o JOIN documents d ON o.o_orderkey = d.doc_id""")

_view("chat_notes", [], """
SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS note_id,
       CAST(conv_id AS VARCHAR) AS subject, CAST(conv_id AS VARCHAR) AS hadm,
       CAST(turn AS INTEGER) AS note_seq, text, conv_id * 4294967296 + turn AS row_ix
FROM conversations""")

_view("scored", ["cohort"], """
SELECT c.id, c.label, c.split, round(o.o_totalprice / 100000.0 - 1.5, 1) AS score, c.row_ix
FROM cohort c JOIN orders o ON c.row_ix = o.o_orderkey""")

_view("predictions", ["cohort"], """
SELECT 0 AS model_id, c.id, round(o.o_totalprice / 100000.0 - 1.5, 1) AS score
FROM cohort c JOIN orders o ON c.row_ix = o.o_orderkey WHERE c.split = 'test'
UNION ALL
SELECT 1, c.id, round(o.o_totalprice / 100000.0 - 1.5, 1) * 0.5 + 0.25
FROM cohort c JOIN orders o ON c.row_ix = o.o_orderkey WHERE c.split = 'test'
UNION ALL
SELECT 2, c.id, -round(o.o_totalprice / 100000.0 - 1.5, 1)
FROM cohort c JOIN orders o ON c.row_ix = o.o_orderkey WHERE c.split = 'test' AND o.o_orderstatus <> 'P'""")

# Cleaned words of every note (X1-X7), in order, as a list.
_view("note_words", ["notes"], f"""
SELECT note_id, row_ix,
       list_filter(
         regexp_split_to_array(
           regexp_replace(lower(regexp_replace(replace(coalesce(text, ''), '___', ' '), '\\n+', chr(10), 'g')),
                          '[^{WORD}{WS}]', ' ', 'g'),
           '[{WS}]+'),
         lambda w: length(w) > 0 AND NOT list_contains({STOP}, w)) AS words
FROM notes""")

_view("note_tokens", ["note_words"], """
SELECT note_id, row_ix, unnest(list_filter(words, lambda w: length(w) >= 2)) AS term FROM note_words""")

_view("doc_terms", ["note_tokens"], """
SELECT note_id, term, count(*) AS cnt FROM note_tokens GROUP BY note_id, term""")

_view("term_stats", ["doc_terms"], """
SELECT term, sum(cnt) AS tf, count(*) AS df FROM doc_terms GROUP BY term""")


def vocabulary_view(n_terms: int) -> str:
    return f"""
SELECT term, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS term_ix, tf, df
FROM (SELECT * FROM term_stats ORDER BY tf DESC, term LIMIT {n_terms}) v"""


_view("vocabulary", ["term_stats"], vocabulary_view(1024))

_view("tfidf", ["doc_terms", "vocabulary"], """
SELECT note_id, term_ix, w / sqrt(sum(w * w) OVER (PARTITION BY note_id)) AS value
FROM (SELECT t.note_id, v.term_ix,
             t.cnt * (ln((1.0 + (SELECT count(*) FROM notes)) / (1.0 + v.df)) + 1.0) AS w
      FROM doc_terms t JOIN vocabulary v ON t.term = v.term) x""")


def with_views(sql: str, *names: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1]}\n)" for n in order)
    body = sql.lstrip()
    for head in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(head):
            return f"{head} {ctes},\n{body[len(head):].lstrip()}"
    return f"WITH {ctes}\n{body}"

"""DuckDB statements of the registered queries (the correctness oracle).

Written independently of the Spark plans: plain SQL windows, joins and
list functions over the same parquet tables. Queries whose result depends on
a random forest, a fitted model or random noise have no statement here (the
driver then checks rows only) and are tested against brute force in pytest.
"""

from __future__ import annotations

from admitflow.plans.catalog import (AFF_BETA, AFF_GAMMA, AFF_MEAN, AFF_VAR, ATTN_B, ATTN_W, BATCH_SIZE, EPOCHS,
                                     FOLD_SEED, K_FOLDS, MISSING_ROWS, NOISE_SEED, NOISE_STD, PLANTED_AT, PROJ_B, PROJ_W, RANGE_PARTS,
                                     SLICE_INDICES, SMALL_AT, SMALL_REG)
from admitflow.plans.oracle_views import _view, with_views

# ------------------------------------------------------------- extra views

_view("curated", ["label_rows"], """
SELECT split, id, max(label) AS label, min(row_ix) AS row_ix
FROM label_rows GROUP BY split, id HAVING count(DISTINCT label) = 1""")

_view("day_long", ["day_rows"], """
SELECT id, day_idx, CAST(generate_subscripts(features, 1) - 1 AS BIGINT) AS feature_ix,
       unnest(features) AS value
FROM day_rows""")

_view("train_stats", ["day_long", "curated"], """
SELECT feature_ix, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n
FROM day_long WHERE id IN (SELECT id FROM curated WHERE split = 'train')
GROUP BY feature_ix""")

_view("scaled_long", ["day_long", "train_stats"], """
SELECT d.id, d.day_idx, d.feature_ix,
       (d.value - s.mean) / CASE WHEN s.std = 0 THEN 1.0 ELSE s.std END AS value
FROM day_long d JOIN train_stats s USING (feature_ix)""")

_view("note_dense", ["notes", "tfidf"], """
SELECT n.note_id, CAST(g.dim AS BIGINT) AS dim, coalesce(t.value, 0.0) AS value
FROM notes n CROSS JOIN range(1024) g(dim)
LEFT JOIN tfidf t ON t.note_id = n.note_id AND t.term_ix = g.dim""")

_view("note_stats", ["note_dense"], """
SELECT dim, avg(value) AS mean, stddev_samp(value) AS std FROM note_dense GROUP BY dim""")

_view("note_z", ["note_dense", "note_stats"], """
SELECT d.note_id, d.dim,
       CASE WHEN s.std = 0 THEN 0.0 ELSE (d.value - s.mean) / s.std END AS value
FROM note_dense d JOIN note_stats s USING (dim)""")

_view("test_ids", ["label_rows"], """
SELECT id, min(row_ix) AS row_ix FROM label_rows WHERE split = 'test' GROUP BY id""")

_view("test_batches", ["test_ids"], f"""
SELECT id, row_ix, (row_number() OVER (ORDER BY row_ix) - 1) // {BATCH_SIZE} AS batch_id,
       (row_number() OVER (ORDER BY row_ix) - 1) % {BATCH_SIZE} AS batch_pos
FROM test_ids""")

_view("subject_notes", ["notes"], """
SELECT subject, count(*) AS n_notes FROM notes GROUP BY subject""")

_view("pred_auc", ["predictions", "cohort"], """
SELECT model_id AS step, n_pos, n_neg,
       CASE WHEN n_pos = 0 OR n_neg = 0 THEN 0.0
            ELSE (rpos - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END AS auc
FROM (SELECT model_id, sum(label * r) AS rpos, sum(label) AS n_pos, sum(1 - label) AS n_neg
      FROM (SELECT p.model_id, c.label, rank() OVER (PARTITION BY p.model_id ORDER BY p.score)
                   + (count(*) OVER (PARTITION BY p.model_id, p.score) - 1) / 2.0 AS r
            FROM predictions p JOIN cohort c USING (id)) x
      GROUP BY model_id) y""")


def _lit_list(xs) -> str:
    return "[" + ", ".join(repr(float(x)) for x in xs) + "]"


Q: dict[str, str] = {}

Q["label_conflicts"] = with_views("""
SELECT split, id, CAST(count(DISTINCT label) AS BIGINT) AS n_labels
FROM label_rows WHERE split IN ('train', 'valid')
GROUP BY split, id HAVING count(DISTINCT label) > 1""", "label_rows")

Q["clean_labels"] = with_views("""
SELECT split, id, CAST(label AS BIGINT) AS label, row_ix FROM curated WHERE split IN ('train', 'valid')""",
                               "curated")

Q["train_plus_valid"] = with_views("""
SELECT id, CAST(max(label) AS BIGINT) AS label, min(row_ix) AS row_ix
FROM label_rows WHERE split IN ('train', 'valid') GROUP BY id HAVING count(DISTINCT label) = 1""",
                                   "label_rows")

Q["test_ids"] = with_views("SELECT id, row_ix FROM test_ids", "test_ids")

Q["class_weights"] = with_views("""
SELECT CAST(label AS BIGINT) AS label, CAST(n AS BIGINT) AS n,
       round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
FROM (SELECT label, count(*) AS n FROM curated WHERE split = 'train' GROUP BY label) c""", "curated")

Q["mean_pool"] = with_views("""
SELECT id, feature_ix, round(avg(value), 6) AS value
FROM day_long WHERE id IN (SELECT id FROM curated WHERE split = 'train')
GROUP BY id, feature_ix""", "day_long", "curated")

Q["scaler_stats"] = with_views("""
SELECT feature_ix, round(mean, 6) AS mean, round(std, 6) AS std, CAST(n AS BIGINT) AS n FROM train_stats""",
                               "train_stats")

Q["scaled_rows"] = with_views("""
SELECT id, CAST(day_idx AS BIGINT) AS day_idx, feature_ix, round(value, 6) AS value FROM scaled_long""",
                              "scaled_long")

_SEL = ", ".join(str(i + 1) for i in SLICE_INDICES)     # 1-based list positions
Q["feature_slice"] = with_views(f"""
SELECT 'wide' AS source, id, CAST(day_idx AS BIGINT) AS day_idx, CAST({len(SLICE_INDICES)} AS BIGINT) AS n_selected,
       round(sum(value * (list_position([{_SEL}], pos + 1))), 6) AS checksum
FROM day_rows_64_long WHERE list_contains([{_SEL}], pos + 1)
GROUP BY id, day_idx
UNION ALL
SELECT 'narrow', id, CAST(day_idx AS BIGINT), CAST({len(SLICE_INDICES)} AS BIGINT), 0.0 FROM day_rows""",
                                "day_rows_64_long", "day_rows")

Q["default_fill"] = with_views(f"""
SELECT c.id, CAST(coalesce(d.n, {MISSING_ROWS}) AS BIGINT) AS n_rows, d.n IS NULL AS filled,
       round(coalesce(d.total, 0.0), 4) AS total
FROM cohort c LEFT JOIN (SELECT id, count(*) AS n, sum(list_sum(features)) AS total FROM day_rows GROUP BY id) d
  USING (id)""", "cohort", "day_rows")

_PE = ("CASE WHEN feature_ix % 2 = 0 THEN sin(day_idx * exp((feature_ix - feature_ix % 2) * (-ln(10000.0) / 8))) "
       "ELSE cos(day_idx * exp((feature_ix - feature_ix % 2) * (-ln(10000.0) / 8))) END")
Q["positional_encoding"] = with_views(f"""
SELECT id, CAST(day_idx AS BIGINT) AS day_idx, round(sum((value + {_PE}) * (feature_ix + 1)), 6) AS checksum
FROM day_long GROUP BY id, day_idx""", "day_long")

Q["attention_pool"] = with_views(f"""
WITH s AS (SELECT id, day_idx, sum(value * {_lit_list(ATTN_W)}[feature_ix + 1]) + {ATTN_B} AS score
           FROM scaled_long GROUP BY id, day_idx),
     w AS (SELECT id, day_idx, exp(score - max(score) OVER (PARTITION BY id)) AS e FROM s),
     p AS (SELECT id, day_idx, e / sum(e) OVER (PARTITION BY id) AS weight FROM w)
SELECT l.id, l.feature_ix, round(sum(l.value * p.weight), 6) AS value
FROM scaled_long l JOIN p USING (id, day_idx) GROUP BY l.id, l.feature_ix""", "scaled_long")

_PROJ = " UNION ALL ".join(
    f"SELECT {o} AS out_ix, {j} AS feature_ix, {w!r} AS w, {PROJ_B[o]!r} AS b"
    for o, row in enumerate(PROJ_W) for j, w in enumerate(row))
Q["dense_projection"] = with_views(f"""
SELECT l.id, CAST(l.day_idx AS BIGINT) AS day_idx, CAST(m.out_ix AS BIGINT) AS out_ix,
       round(sum(l.value * m.w) + max(m.b), 6) AS value
FROM scaled_long l JOIN ({_PROJ}) m USING (feature_ix) GROUP BY l.id, l.day_idx, m.out_ix""", "scaled_long")

Q["affine_normalise"] = with_views(f"""
SELECT id, feature_ix,
       round((avg(value) - {_lit_list(AFF_MEAN)}[feature_ix + 1]) / sqrt({_lit_list(AFF_VAR)}[feature_ix + 1] + 1e-5)
             * {_lit_list(AFF_GAMMA)}[feature_ix + 1] + {_lit_list(AFF_BETA)}[feature_ix + 1], 6) AS value
FROM day_long GROUP BY id, feature_ix""", "day_long")

Q["vector_concat"] = with_views("""
WITH pooled AS (SELECT id, feature_ix AS ix, avg(value) AS value FROM day_long GROUP BY id, feature_ix),
     ids AS (SELECT DISTINCT id FROM day_long),
     extra AS (SELECT i.id, coalesce(s.n_notes, 0) AS n_notes,
                      CASE WHEN i.id IN (SELECT note_id FROM notes) THEN 1.0 ELSE 0.0 END AS has_note
               FROM ids i LEFT JOIN subject_notes s ON s.subject = split_part(i.id, '_', 1))
SELECT id, ix, round(value, 6) AS value FROM pooled
UNION ALL SELECT id, 8, round(CAST(n_notes AS DOUBLE), 6) FROM extra
UNION ALL SELECT id, 9, round(has_note, 6) FROM extra""", "day_long", "subject_notes", "notes")

Q["clean_text"] = with_views("SELECT note_id, array_to_string(words, ' ') AS clean_text FROM note_words",
                             "note_words")

Q["term_stats"] = with_views("SELECT term, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df FROM term_stats",
                             "term_stats")

Q["vocabulary"] = with_views("""
SELECT term, CAST(term_ix AS BIGINT) AS term_ix, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df
FROM vocabulary""", "vocabulary")

Q["tfidf"] = with_views("SELECT note_id, CAST(term_ix AS BIGINT) AS term_ix, round(value, 6) AS value FROM tfidf",
                        "tfidf")

Q["tfidf_dense"] = with_views("""
SELECT n.note_id, CAST(1024 AS BIGINT) AS width, CAST(count(t.term_ix) AS BIGINT) AS nnz,
       round(coalesce(sum(t.value * t.value), 0.0), 6) AS sumsq,
       round(coalesce(sum(t.value * (t.term_ix + 1)), 0.0), 6) AS checksum
FROM notes n LEFT JOIN tfidf t USING (note_id) GROUP BY n.note_id""", "notes", "tfidf")

Q["note_labels"] = with_views("""
SELECT note_id, subject, hadm,
       CAST(CASE WHEN regexp_full_match(trim(CAST(note_seq AS VARCHAR)), '[+-]?[0-9]+')
                 THEN coalesce(TRY_CAST(trim(CAST(note_seq AS VARCHAR)) AS INTEGER), -1) ELSE -1 END AS BIGINT)
       AS note_seq FROM notes""", "notes")

_ORDER = """
SELECT note_id, subject, CAST(note_seq AS BIGINT) AS note_seq,
       CAST(row_number() OVER (PARTITION BY subject ORDER BY note_seq, note_id) - 1 AS BIGINT) AS note_pos
FROM {src}"""
Q["note_order"] = with_views(_ORDER.format(src="notes"), "notes")
Q["chat_note_order"] = with_views(_ORDER.format(src="chat_notes"), "chat_notes")

Q["related_notes"] = with_views("""
SELECT c.id, split_part(c.id, '_', 1) AS subject, CAST(coalesce(s.n_notes, 0) AS BIGINT) AS n_notes
FROM cohort c LEFT JOIN subject_notes s ON s.subject = split_part(c.id, '_', 1)""", "cohort", "subject_notes")

Q["related_notes_contains"] = with_views("""
SELECT s.subject, n.note_id
FROM (SELECT DISTINCT subject FROM notes) s JOIN notes n ON contains(n.note_id, s.subject)""", "notes")

Q["related_notes_automaton"] = Q["related_notes_contains"]

Q["note_gate"] = with_views("""
SELECT c.id, c.id IN (SELECT note_id FROM notes) AS has_note FROM cohort c""", "cohort", "notes")

Q["note_stats"] = with_views("""
SELECT dim, round(mean, 6) AS mean, round(std, 6) AS std FROM note_stats""", "note_stats")

Q["note_stats_train"] = with_views("""
SELECT dim, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std
FROM note_dense JOIN notes USING (note_id) WHERE row_ix % 10 < 7 GROUP BY dim""", "note_dense", "notes")

Q["merged_scaler"] = with_views("""
SELECT feature_ix, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM day_long GROUP BY feature_ix""", "day_long")

Q["keyed_read"] = """
SELECT CAST(vec_id AS VARCHAR) AS note_id, CAST(len(embedding) AS BIGINT) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS s1
FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE doc_id % 100 = 0)"""

Q["notes_standardised"] = with_views("""
SELECT note_id, round(sum(value), 6) AS s1, round(sum(value * value), 6) AS s2 FROM note_z GROUP BY note_id""",
                                     "note_z")

Q["note_sequences"] = with_views("""
SELECT n.subject, CAST(row_number() OVER (PARTITION BY n.subject ORDER BY n.note_seq, n.note_id) - 1 AS BIGINT)
       AS note_pos, n.note_id, round(coalesce(t.s, 0.0), 6) AS vec_sum
FROM notes n LEFT JOIN (SELECT note_id, sum(value) AS s FROM tfidf GROUP BY note_id) t USING (note_id)""",
                                 "notes", "tfidf")

_view("day_sums", ["scaled_long"], """
SELECT id, day_idx AS pos, sum(value) AS s1, sum(value * (feature_ix + 1)) AS chk FROM scaled_long GROUP BY id, day_idx""")

_view("sample_days", ["cohort", "day_sums"], f"""
SELECT id, CAST(pos AS BIGINT) AS pos, s1, chk FROM day_sums JOIN cohort USING (id)
UNION ALL
SELECT id, pos, 0.0, 0.0 FROM cohort, range({MISSING_ROWS}) r(pos) WHERE id NOT IN (SELECT id FROM day_sums)""")

_view("note_pos", ["notes"], """
SELECT subject, note_id, row_number() OVER (PARTITION BY subject ORDER BY note_seq, note_id) - 1 AS pos FROM notes""")

_view("sample_notes", ["cohort", "note_pos"], """
SELECT c.id, p.pos, p.note_id FROM cohort c JOIN note_pos p USING (subject) WHERE c.id IN (SELECT note_id FROM notes)
UNION ALL
SELECT id, 0, NULL FROM cohort WHERE id NOT IN (SELECT note_id FROM notes)""")

Q["assemble"] = with_views("""
WITH z AS (SELECT note_id, sum(value) AS s1, sum(value * (dim + 1)) AS chk FROM note_z GROUP BY note_id),
r AS (SELECT id, 'day' AS branch, pos, NULL AS note_id, s1, chk FROM sample_days
      UNION ALL
      SELECT id, 'note', pos, n.note_id, coalesce(s1, 0.0), coalesce(chk, 0.0) FROM sample_notes n LEFT JOIN z USING (note_id))
SELECT id, split, CAST(CASE WHEN split = 'test' THEN NULL ELSE label END AS DOUBLE) AS label,
       id IN (SELECT note_id FROM notes) AS has_note, branch, pos, r.note_id, round(s1, 5) AS s1, round(chk, 4) AS chk
FROM cohort JOIN r USING (id)""", "cohort", "sample_days", "sample_notes", "note_z", "notes")

Q["assemble_stored"] = with_views("""
WITH z AS (SELECT note_id, sum(value) AS s1, sum(value * (dim + 1)) AS chk FROM note_z GROUP BY note_id)
SELECT id, 'day' AS branch, pos, NULL AS note_id, round(s1, 5) AS s1, round(chk, 4) AS chk FROM sample_days
UNION ALL
SELECT n.id, 'note', n.pos, n.note_id, round(z.s1, 5), round(z.chk, 4) FROM sample_notes n JOIN z USING (note_id)""", "sample_days", "sample_notes", "note_z")

_view("train_batches", ["curated"], f"""
SELECT id, (row_number() OVER (ORDER BY md5(id || '|{FOLD_SEED}'), id) - 1) // {BATCH_SIZE} AS batch_id
FROM curated WHERE split = 'train'""")

_view("note_sums", ["note_z"], """
SELECT note_id, sum(value) AS s1, sum(value * (dim + 1)) AS chk FROM note_z GROUP BY note_id""")

_COLLATE = """
r AS (SELECT b.batch_id, d.id, 'day' AS branch, d.pos, NULL AS note_id, d.s1, d.chk FROM sample_days d JOIN {src} b USING (id)
      UNION ALL
      SELECT b.batch_id, n.id, 'note', n.pos, n.note_id, coalesce(z.s1, 0.0), coalesce(z.chk, 0.0)
      FROM sample_notes n JOIN {src} b USING (id) LEFT JOIN note_sums z USING (note_id)),
len AS (SELECT batch_id, id, branch, max(pos) + 1 AS n FROM r GROUP BY ALL),
longest AS (SELECT batch_id, branch, max(n) AS m FROM len GROUP BY ALL),
padded AS (SELECT batch_id, id, branch, CAST(unnest(range(n, m)) AS BIGINT) AS pos FROM len JOIN longest USING (batch_id, branch)),
out AS (SELECT batch_id, id, branch, pos, note_id, false AS padded, s1, chk FROM r
        UNION ALL SELECT batch_id, id, branch, pos, NULL, true, 0.0, 0.0 FROM padded)"""
Q["collate"] = with_views(f"""
WITH {_COLLATE.format(src="test_batches")}
SELECT CAST(batch_id AS BIGINT) AS batch_id, id, branch, pos, note_id, padded, round(s1, 5) AS s1, round(chk, 4) AS chk FROM out""",
                          "test_batches", "sample_days", "sample_notes", "note_sums")
Q["collate_train"] = with_views(f"""
WITH {_COLLATE.format(src="train_batches")}
SELECT CAST(batch_id AS BIGINT) AS batch_id, branch, count(*) AS n_rows, count(*) FILTER (padded) AS n_padded,
       max(pos) + 1 AS max_len, round(sum(s1), 3) AS s1
FROM out GROUP BY batch_id, branch""", "train_batches", "sample_days", "sample_notes", "note_sums")
Q["batch_store"] = with_views(f"""
WITH {_COLLATE.format(src="test_batches")}
SELECT CAST(batch_id AS BIGINT) AS batch_id, count(*) FILTER (branch = 'day') AS day_rows, count(*) FILTER (branch = 'day' AND padded) AS day_padded,
       round(sum(chk) FILTER (branch = 'day'), 3) AS day_chk, count(*) FILTER (branch = 'note') AS note_rows,
       count(*) FILTER (branch = 'note' AND padded) AS note_padded, round(sum(chk) FILTER (branch = 'note'), 2) AS note_chk
FROM out GROUP BY batch_id""", "test_batches", "sample_days", "sample_notes", "note_sums")

_view("admissions", [], """
SELECT CAST(o_custkey AS VARCHAR) || '_' || CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS subject,
       CAST(o_orderdate AS DATE) AS day, o_orderkey AS row_ix FROM orders""")

_view("seen", ["admissions"], """
SELECT a.id, a.subject, a.day, n.id AS note_id, n.day AS note_day, n.row_ix AS note_ix
FROM admissions a LEFT JOIN (SELECT * FROM admissions WHERE row_ix IN (SELECT doc_id FROM documents)) n
  ON n.subject = a.subject AND (n.day < a.day OR n.day = a.day AND n.row_ix <= a.row_ix)""")

Q["as_of_notes"] = with_views("""
SELECT id, subject, count(note_id) AS n_before, coalesce(max_by(note_id, struct_pack(d := note_day, i := note_ix)), '') AS last_note,
       coalesce(date_diff('day', max(note_day), day), -1) AS age
FROM seen GROUP BY id, subject, day""", "seen")

Q["as_of_pool"] = with_views("""
SELECT id, count(note_id) AS n_before, round(coalesce(sum(s1) / count(note_id), 0.0), 4) AS s1, round(coalesce(sum(chk) / count(note_id), 0.0), 3) AS chk
FROM seen LEFT JOIN note_sums USING (note_id) GROUP BY id""", "seen", "note_sums")

Q["as_of_rows"] = with_views("""
SELECT s.id, s.pos, s.note_id FROM sample_notes s JOIN (SELECT id, count(note_id) AS n FROM seen GROUP BY id) USING (id)
WHERE s.note_id IS NULL OR s.pos < n""", "sample_notes", "seen")

_U = "(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', '{k}', id, day_idx, feature_ix)), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0"
Q["noise_augment"] = with_views(f"""
SELECT id, CAST(day_idx AS BIGINT) AS day_idx,
       round(sum(value + {NOISE_STD} * sqrt(-2.0 * ln({_U.format(seed=NOISE_SEED, k=1)})) * cos(2 * 3.141592653589793 * ({_U.format(seed=NOISE_SEED, k=2)}))), 6) AS total
FROM day_long WHERE id IN (SELECT id FROM curated WHERE split = 'train') GROUP BY id, day_idx""", "day_long", "curated")

Q["selected_rows"] = with_views("""
SELECT id, CAST(day AS VARCHAR) AS day, CAST(32 AS BIGINT) AS n_selected, true AS complete FROM day_rows""", "day_rows")

Q["candidate_report"] = with_views("""
SELECT CAST(step AS BIGINT) AS step, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, true AS auc_in_range
FROM curated, range(3) r(step) WHERE split = 'valid' GROUP BY step""", "curated")

Q["kfold_report"] = with_views(f"""
WITH f AS (SELECT label, ntile({K_FOLDS}) OVER (ORDER BY md5(id || '|{FOLD_SEED}'), id) - 1 AS fold FROM curated WHERE split <> 'test')
SELECT CAST(fold AS BIGINT) AS fold, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, true AS auc_in_range
FROM f GROUP BY fold""", "curated")

_view("two", ["scaled_long", "curated"], f"""
SELECT id, CAST(label AS DOUBLE) AS y, x1, x2, ntile({K_FOLDS}) OVER (ORDER BY md5(id || '|{FOLD_SEED}'), id) - 1 AS fold,
       count(*) OVER () / (2.0 * count(*) OVER (PARTITION BY label)) AS w
FROM (SELECT id, max(label) AS label, avg(value) FILTER (feature_ix = {SMALL_AT[0]}) AS x1, avg(value) FILTER (feature_ix = {SMALL_AT[1]}) AS x2
      FROM scaled_long JOIN curated USING (id) WHERE split = 'train' GROUP BY id)""")

# Newton's method for every fold: gradient g and matrix h of the weighted loss, solved by determinants
_NEWTON = f"""
WITH RECURSIVE step AS (
  SELECT f AS fold, 0 AS k, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c FROM range({K_FOLDS}) t(f)
  UNION ALL
  SELECT fold, k + 1, a - (g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3)) / det,
         b - (h11 * (g2 * h33 - g3 * h23) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13)) / det,
         c - (h11 * (h22 * g3 - h23 * g2) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13)) / det
  FROM (
    SELECT *, h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS det FROM (
      SELECT fold, k, a, b, c, sum(w * (p - y) * x1) / sum(w) + {SMALL_REG} * a AS g1, sum(w * (p - y) * x2) / sum(w) + {SMALL_REG} * b AS g2,
             sum(w * (p - y)) / sum(w) AS g3, sum(w * p * (1 - p) * x1 * x1) / sum(w) + {SMALL_REG} AS h11,
             sum(w * p * (1 - p) * x2 * x2) / sum(w) + {SMALL_REG} AS h22, sum(w * p * (1 - p)) / sum(w) AS h33,
             sum(w * p * (1 - p) * x1 * x2) / sum(w) AS h12, sum(w * p * (1 - p) * x1) / sum(w) AS h13, sum(w * p * (1 - p) * x2) / sum(w) AS h23
      FROM (SELECT step.*, two.w, two.y, two.x1, two.x2, 1 / (1 + exp(-(a * x1 + b * x2 + c))) AS p
            FROM step JOIN two ON two.fold <> step.fold WHERE k < 8)
      GROUP BY fold, k, a, b, c))),
model AS (SELECT fold, a, b, c FROM step WHERE k = 8)"""

Q["fold_models"] = with_views(f"""{_NEWTON}
SELECT fold, ix, round(CASE ix WHEN 0 THEN a WHEN 1 THEN b ELSE c END, 6) AS value
FROM model, (SELECT unnest([0, 1, -1]) AS ix)""", "two")

Q["fold_auc"] = with_views(f"""{_NEWTON},
own AS (SELECT fold, y, round(a * x1 + b * x2 + c, 8) AS z FROM two JOIN model USING (fold)),
ranked AS (SELECT fold, y, rank() OVER (PARTITION BY fold ORDER BY z) + (count(*) OVER (PARTITION BY fold, z) - 1) / 2.0 AS r FROM own)
SELECT fold, round((sum(y * r) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)), 6) AS auc,
       CAST(sum(y) AS BIGINT) AS n_pos, CAST(sum(1 - y) AS BIGINT) AS n_neg FROM ranked GROUP BY fold""", "two")

Q["fold_probabilities"] = with_views(f"""{_NEWTON}
SELECT id, round(score, 6) AS score, round(1 / (1 + exp(-score)), 6) AS probability
FROM (SELECT id, sum(a * x1 + b * x2 + c) / {K_FOLDS} AS score FROM two, model GROUP BY id)""", "two")

Q["planted_selection"] = with_views(f"""
WITH own AS (
  SELECT DISTINCT d.id, d.day, c.label + 0.5 * CAST(('0x' || substr(md5(d.id), 1, 4)) AS BIGINT) / 65536.0 AS v,
         d.id IN (SELECT id FROM curated WHERE split = 'train') AS train
  FROM day_rows d JOIN (SELECT id, max(label) AS label FROM curated GROUP BY id) c USING (id))
SELECT id, CAST(day AS VARCHAR) AS day, CAST({PLANTED_AT} AS BIGINT) AS feature_ix,
       round((v - (SELECT avg(v) FROM own WHERE train)) / (SELECT stddev_pop(v) FROM own WHERE train), 6) AS value FROM own""", "day_rows", "curated")

Q["kfold"] = with_views(f"""
SELECT id, CAST(ntile({K_FOLDS}) OVER (ORDER BY md5(id || '|{FOLD_SEED}'), id) - 1 AS BIGINT) AS fold_exact,
       CAST(CAST(('0x' || substr(md5(id || '|{FOLD_SEED}'), 1, 8)) AS BIGINT) % {K_FOLDS} AS BIGINT) AS fold_hash
FROM curated WHERE split = 'train'""", "curated")

Q["range_split"] = with_views(f"""
SELECT note_id, CAST(CASE WHEN count(*) OVER () // {RANGE_PARTS} = 0 THEN {RANGE_PARTS - 1}
       ELSE least((row_number() OVER (ORDER BY row_ix) - 1) // (count(*) OVER () // {RANGE_PARTS}),
                  {RANGE_PARTS - 1}) END AS BIGINT) AS part
FROM notes""", "notes")

Q["shuffle_order"] = with_views(f"""
SELECT id, CAST(row_number() OVER (ORDER BY md5(id || '|{FOLD_SEED}'), id) - 1 AS BIGINT) AS shuffle_ix
FROM curated WHERE split = 'train'""", "curated")

Q["batches"] = with_views("""
SELECT id, CAST(batch_id AS BIGINT) AS batch_id, CAST(batch_pos AS BIGINT) AS batch_pos FROM test_batches""",
                          "test_batches")

_NOISE = "CAST(('0x' || substr(md5(concat_ws('|', '{seed}', epoch, {k}, {r})), 1, 12)) AS BIGINT)"


def _feistel(x: str) -> str:
    """Four rounds over (left, right) to the base s."""
    turn = _NOISE.format(seed=FOLD_SEED, k="k", r="p.r")
    step = f"struct_pack(l := p.r, r := (p.l + {turn}) % s, k := k + 1)".replace("k + 1", "p.k + 1").replace(", k,", ", p.k,")
    start = f"struct_pack(l := {x} // s, r := {x} % s, k := CAST(1 AS BIGINT))"
    done = f"list_reduce([{start}, {start}, {start}, {start}, {start}], lambda p, z: {step})"
    return f"({done}.l * s + {done}.r)"


Q["epoch_batches"] = with_views(f"""
WITH RECURSIVE ids AS (
  SELECT id, row_number() OVER (ORDER BY id) - 1 AS ix, count(*) OVER () AS n, CAST(ceil(sqrt(count(*) OVER ())) AS BIGINT) AS s
  FROM curated WHERE split = 'train'),
walk AS (
  SELECT id, n, s, epoch, {_feistel("ix")} AS x FROM ids, range({EPOCHS}) t(epoch)
  UNION ALL
  SELECT id, n, s, epoch, {_feistel("x")} FROM walk WHERE x >= n)
SELECT id, epoch, x AS shuffle_ix, x // {BATCH_SIZE} AS batch_id, x % {BATCH_SIZE} AS batch_pos FROM walk WHERE x < n""", "curated")

Q["padding_masks"] = with_views(f"""
WITH x AS (
  SELECT b.id, b.batch_id, coalesce(d.n, {MISSING_ROWS}) AS seq_len,
         CASE WHEN b.id IN (SELECT note_id FROM notes) THEN coalesce(s.n_notes, 0) ELSE 1 END AS note_len
  FROM test_batches b
  LEFT JOIN (SELECT id, count(*) AS n FROM day_rows GROUP BY id) d USING (id)
  LEFT JOIN subject_notes s ON s.subject = split_part(b.id, '_', 1))
SELECT id, CAST(batch_id AS BIGINT) AS batch_id, CAST(seq_len AS BIGINT) AS seq_len,
       CAST(max(seq_len) OVER (PARTITION BY batch_id) AS BIGINT) AS max_len,
       CAST(max(seq_len) OVER (PARTITION BY batch_id) - seq_len AS BIGINT) AS n_masked,
       CAST(note_len AS BIGINT) AS note_len,
       CAST(max(note_len) OVER (PARTITION BY batch_id) AS BIGINT) AS note_max_len,
       CAST(max(note_len) OVER (PARTITION BY batch_id) - note_len AS BIGINT) AS note_n_masked
FROM x""", "test_batches", "day_rows", "notes", "subject_notes")

Q["padding_masks_compat"] = Q["padding_masks"].replace(
    "CAST(max(note_len) OVER (PARTITION BY batch_id) - note_len AS BIGINT) AS note_n_masked",
    "CAST(CASE WHEN id IN (SELECT note_id FROM notes) THEN max(note_len) OVER (PARTITION BY batch_id) - note_len "
    "ELSE greatest(max(note_len) OVER (PARTITION BY batch_id) - 1024, 0) END AS BIGINT) AS note_n_masked")

Q["focal_loss"] = with_views("""
WITH w AS (SELECT count(*) / (count(DISTINCT label) * sum(label)) AS alpha FROM scored WHERE split = 'train'),
     l AS (SELECT split, score AS x, label * 0.9 + 0.05 AS y FROM scored),
     b AS (SELECT split, greatest(x, 0.0) - x * y + ln(1 + exp(-abs(x))) AS bce FROM l)
SELECT split, round(avg((SELECT alpha FROM w) * pow(1 - exp(-bce), 2) * bce), 6) AS loss,
       CAST(count(*) AS BIGINT) AS n
FROM b GROUP BY split""", "scored")

Q["focal_loss_positive"] = Q["focal_loss"].replace("(SELECT alpha FROM w) * pow", "CASE WHEN pos = 1 THEN (SELECT alpha FROM w) ELSE 1.0 END * pow").replace(
    "SELECT split, score AS x,", "SELECT split, label AS pos, score AS x,").replace("b AS (SELECT split,", "b AS (SELECT split, pos,")

Q["roc_auc"] = with_views("""
SELECT split, round(CASE WHEN n_pos = 0 OR n_neg = 0 THEN 0.0
                         ELSE (rpos - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg) END, 6) AS auc,
       CAST(n_pos AS BIGINT) AS n_pos, CAST(n_neg AS BIGINT) AS n_neg
FROM (SELECT split, sum(label * r) AS rpos, sum(label) AS n_pos, sum(1 - label) AS n_neg
      FROM (SELECT split, label, rank() OVER (PARTITION BY split ORDER BY score)
                   + (count(*) OVER (PARTITION BY split, score) - 1) / 2.0 AS r FROM scored) x
      GROUP BY split) y""", "scored")

Q["ensemble_mean"] = with_views("""
SELECT id, round(sum(coalesce(score, 0.0)) / (SELECT count(DISTINCT model_id) FROM predictions), 6) AS score
FROM predictions GROUP BY id""", "predictions")

Q["prediction_join"] = with_views("""
SELECT t.id, t.row_ix, round(p.score, 6) AS score
FROM test_ids t LEFT JOIN (SELECT id, arg_max(score, model_id) AS score FROM predictions GROUP BY id) p USING (id)""",
                                  "test_ids", "predictions")

Q["best_model"] = with_views("""
SELECT CAST(step AS BIGINT) AS step, round(auc, 6) AS auc FROM pred_auc
ORDER BY auc DESC, step LIMIT 1""", "pred_auc")

Q["incremental_pending"] = with_views("""
SELECT note_id, row_ix FROM notes WHERE row_ix NOT IN (SELECT doc_id FROM labels)""", "notes")

Q["pooled_embeddings"] = with_views("""
WITH toks AS (SELECT note_id, unnest(words) AS token FROM note_words),
     tv AS (SELECT t.token, e.embedding FROM (SELECT DISTINCT token FROM toks) t
            JOIN embeddings e
              ON e.vec_id = CAST(('0x' || substr(md5(t.token), 1, 8)) AS BIGINT) % (SELECT count(*) FROM embeddings)),
     u AS (SELECT k.note_id, CAST(generate_subscripts(tv.embedding, 1) - 1 AS BIGINT) AS dim,
                  CAST(unnest(tv.embedding) AS DOUBLE) AS v
           FROM toks k JOIN tv USING (token))
SELECT note_id, dim, round(avg(v), 6) AS value FROM u GROUP BY note_id, dim""", "note_words")


def _plus_zero(sql: str) -> str:
    """Wrap every ``round(...)`` as ``(round(...) + 0.0)`` so that a value
    rounded to zero is +0.0 (as in Spark), not -0.0."""
    out, i, low = [], 0, sql.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql[i:])
                return "".join(out)
            out.append(sql[i:j + 6])
            i = j + 6
            continue
        depth, k = 0, j + 5
        while True:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            if depth == 0:
                break
            k += 1
        out.append(sql[i:j] + "(" + sql[j:j + 6] + _plus_zero(sql[j + 6:k]) + ") + 0.0)")
        i = k + 1


def statements() -> dict[str, str]:
    return {k: _plus_zero(v) for k, v in Q.items()}

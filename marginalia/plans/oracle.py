"""SQL with the results of the queries, for a second engine on the same tables."""

from __future__ import annotations

# The code points that count as blank.
BLANK = (
    r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def reason(text: str = "text", null_reason: str = "empty") -> str:
    return (
        f"CASE WHEN {text} IS NULL THEN '{null_reason}' WHEN {text} = '' THEN 'empty' "
        f"WHEN {strip(text)} = '' THEN 'whitespace' WHEN lower({text}) = 'nan' THEN 'nan' "
        "ELSE 'none' END"
    )


DIRTY_TEXT = (
    "CASE WHEN doc_id % 100 = 0 THEN '' WHEN doc_id % 97 = 0 THEN '   ' "
    "WHEN doc_id % 89 = 0 THEN NULL WHEN doc_id % 83 = 0 THEN CAST(doc_id AS VARCHAR) "
    "ELSE text END"
)
COMMENTS = f"comments AS (SELECT doc_id, {DIRTY_TEXT} AS text, lang, source AS source_file FROM documents)"
TRIAGED = f"{COMMENTS}, triaged AS (SELECT *, {reason()} AS skip_reason FROM comments)"
LABELLED = (
    "labelled AS (SELECT d.doc_id, d.text, list_filter([d.lang, "
    "CASE WHEN l.quality = 1 THEN 'quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], "
    "lambda x: x IS NOT NULL) AS labels FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
)
TAGGED = (
    "tagged AS (SELECT d.doc_id, list_filter([CASE WHEN d.lang <> 'en' THEN d.lang END, "
    "CASE WHEN l.quality = 1 THEN 'quality' END, CASE WHEN l.toxic = 1 THEN 'toxic' END], "
    "lambda x: x IS NOT NULL) AS labels "
    "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)
CELLS = (
    "cells AS (SELECT doc_id, CASE WHEN n_chars < 30 THEN NULL WHEN n_chars < 60 THEN '  ' || chr(9) "
    "WHEN n_chars < 300 THEN source WHEN n_chars < 600 THEN lang || ';' || source || '; ' "
    "WHEN lang = 'en' THEN lang || ' , ' || source || ',, x;y ' "
    "WHEN lang = 'fr' THEN lang || ',' || source || '|b;c| |' "
    "WHEN lang = 'de' THEN '[''' || lang || ''', \"' || source || '\", '' '', None, 1.50, -7,]' "
    "ELSE '[' || lang || ', ' || source || ']' END AS cell FROM documents)"
)


def _clean(items: str) -> str:
    return (
        f"list_filter(list_transform({items}, lambda x: {strip('x')}), "
        "lambda x: x IS NOT NULL AND x <> '')"
    )


PARSED = f"""
    CASE WHEN cell IS NULL OR {strip('cell')} = '' THEN []
         WHEN cell LIKE '[''%,]' THEN {_clean('''list_transform(
                 regexp_extract_all(cell, '''+r"""'''[^'']*''|"[^"]*"|-?[0-9.]+|None'"""+'''),
                 lambda x: CASE WHEN x[1] IN ('"', '\'\'') THEN x[2:-2]
                                WHEN contains(x, '.') THEN CAST(CAST(x AS DOUBLE) AS VARCHAR)
                                ELSE x END)''')}
         WHEN contains(cell, '|') THEN {_clean("string_split(cell, '|')")}
         WHEN contains(cell, ',') THEN {_clean("string_split(cell, ',')")}
         WHEN contains(cell, ';') THEN {_clean("string_split(cell, ';')")}
         ELSE [{strip('cell')}] END"""


def text_facts(relation: str) -> str:
    return (
        "SELECT count(*) AS total_rows, "
        "count(*) - count(DISTINCT text) - max(CASE WHEN text IS NULL THEN 1 ELSE 0 END) AS duplicates, "
        "count(*) FILTER (text IS NULL) AS null_texts, "
        f"count(*) FILTER ({strip('text')} = '') AS blank_texts, "
        "count(*) FILTER (length(text) < 10) AS short_texts, "
        f"count(*) FILTER (length(text) > 1000) AS long_texts FROM {relation}"
    )


def gate(relation: str) -> str:
    """CTEs ``facts``, ``spread`` and ``rules`` of the training gate over ``relation``."""
    return f"""
    facts AS ({text_facts(relation)}),
    per_label AS (SELECT label, count(*) AS c
                  FROM (SELECT unnest(labels) AS label FROM {relation}) GROUP BY label),
    spread AS (SELECT count(*) AS n_labels, count(*) FILTER (c < 5) AS rare,
                      coalesce(max(c) / min(c), 0) AS ratio FROM per_label),
    rules(position, rule, severity, observed, limit_value, passed) AS (
      SELECT 1, 'enough_rows', 'error', total_rows, 50, total_rows >= 50 FROM facts UNION ALL
      SELECT 2, 'duplicates', 'warning', duplicates, total_rows * 0.1::DOUBLE,
             duplicates <= total_rows * 0.1::DOUBLE FROM facts UNION ALL
      SELECT 3, 'no_blank_text', 'error', blank_texts, 0, blank_texts = 0 FROM facts UNION ALL
      SELECT 4, 'short_texts', 'warning', short_texts, total_rows * 0.2::DOUBLE,
             short_texts <= total_rows * 0.2::DOUBLE FROM facts UNION ALL
      SELECT 5, 'has_labels', 'error', n_labels, 1, n_labels > 0 FROM spread UNION ALL
      SELECT 6, 'enough_per_label', 'error', rare, 0, rare = 0 FROM spread UNION ALL
      SELECT 7, 'imbalance', 'warning', ratio, 20, ratio <= 20 FROM spread)"""


RULE_COLUMNS = (
    "CAST(position AS BIGINT) AS position, rule, severity, CAST(observed AS DOUBLE) AS observed, "
    "CAST(limit_value AS DOUBLE) AS limit_value, passed"
)


def split(relation: str, test: float, valid: float) -> str:
    """CTE ``parts``: ``relation`` with its split."""
    return f"""
    ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS pos,
                      count(*) OVER () AS total FROM {relation}),
    parts AS (SELECT * EXCLUDE (pos, total),
                     CASE WHEN pos < floor(total * {test}::DOUBLE) THEN 'test'
                          WHEN pos < floor(total * {test}::DOUBLE) + floor(total * {valid}::DOUBLE)
                          THEN 'validation' ELSE 'train' END AS split FROM ranked)"""


def counts(relation: str) -> str:
    """CTEs with the document counts of a fit on ``relation``."""
    return f"""
    doc_tokens AS (SELECT doc_id, labels, unnest(list_distinct({TOKENS})) AS token FROM {relation}),
    n_docs AS (SELECT count(*) AS total FROM {relation}),
    n_label AS (SELECT label, count(DISTINCT doc_id) AS nl
                FROM (SELECT doc_id, unnest(labels) AS label FROM {relation}) GROUP BY label),
    df_token AS (SELECT token, count(*) AS df FROM doc_tokens GROUP BY token),
    df_pair AS (SELECT token, label, count(*) AS dfl
                FROM (SELECT doc_id, token, unnest(list_distinct(labels)) AS label FROM doc_tokens)
                GROUP BY token, label)"""


def weights(alpha: str = "1.0", names: str = "n_label") -> str:
    """CTEs ``weights`` and ``bias`` from the counts."""
    p = f"((coalesce(dfl, 0) + {alpha}) / (nl + 2 * {alpha}))"
    q = f"((df - coalesce(dfl, 0) + {alpha}) / (total - nl + 2 * {alpha}))"
    return f"""
    cells_w AS (SELECT t.token, t.df, v.label, v.nl, n.total, c.dfl
                FROM df_token t CROSS JOIN {names} v CROSS JOIN n_docs n
                LEFT JOIN df_pair c ON c.token = t.token AND c.label = v.label
                WHERE t.df >= 2),
    weights AS (SELECT token, df, label,
                       CAST(round(ln({p} * (1 - {q}) / ({q} * (1 - {p}))) * 1000000) AS BIGINT) AS weight,
                       CAST(round(ln((1 - {p}) / (1 - {q})) * 1000000) AS BIGINT) AS absent
                FROM cells_w),
    bias AS (SELECT v.label,
                    CAST(round(ln((v.nl + {alpha}) / (n.total - v.nl + {alpha})) * 1000000) AS BIGINT)
                    + coalesce((SELECT CAST(sum(absent) AS BIGINT) FROM weights w WHERE w.label = v.label), 0) AS b
             FROM {names} v CROSS JOIN n_docs n)"""


def scores(relation: str) -> str:
    """CTE ``scored``: (doc_id, label, skip_reason, z, prob) for every row of ``relation``."""
    return f"""
    row_tokens AS (SELECT doc_id, unnest(list_distinct({TOKENS})) AS token
                   FROM {relation} WHERE skip_reason = 'none'),
    sums AS (SELECT r.doc_id, w.label, CAST(sum(w.weight) AS BIGINT) AS s
             FROM row_tokens r JOIN weights w ON r.token = w.token GROUP BY r.doc_id, w.label),
    scored AS (SELECT r.doc_id, b.label, r.skip_reason, coalesce(s.s, 0) + b.b AS z,
                      CASE WHEN r.skip_reason = 'none'
                           THEN 1 / (1 + exp(-(coalesce(s.s, 0) + b.b) / 1000000.0::DOUBLE))
                           ELSE 0.0::DOUBLE END AS prob
               FROM {relation} r CROSS JOIN bias b
               LEFT JOIN sums s ON s.doc_id = r.doc_id AND s.label = b.label)"""


def confusion(truth: str) -> str:
    """CTEs ``cells_m`` and ``per_label`` comparing ``scored`` with the labels of ``truth``."""
    return f"""
    cells_m AS (SELECT s.doc_id, s.label, CAST(list_contains(t.labels, s.label) AS INT) AS y,
                       CAST(s.prob >= 0.5 AS INT) AS g
                FROM scored s JOIN {truth} t ON s.doc_id = t.doc_id),
    {CONFUSION}"""


CONFUSION = """per_label AS (SELECT label, CAST(sum(y * g) AS BIGINT) AS tp, CAST(sum((1 - y) * g) AS BIGINT) AS fp,
                         CAST(sum(y * (1 - g)) AS BIGINT) AS fn FROM cells_m GROUP BY label),
    exact AS (SELECT avg(CAST(same AS DOUBLE)) AS exact_match
              FROM (SELECT min(CASE WHEN y = g THEN 1 ELSE 0 END) AS same FROM cells_m GROUP BY doc_id))"""


F1 = "coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)"
CLEAN = "clean AS (SELECT doc_id, text, 'none' AS skip_reason FROM documents)"
FIT = f"{LABELLED}, {counts('labelled')}, {weights()}"
PREDICTED = (
    "coalesce(string_agg(label, '|' ORDER BY label) FILTER (prob >= 0.5), '') AS predicted"
)

FILE_RESULTS = f"""{TRIAGED}, results AS (
    SELECT source_file, 'ok' AS status, count(*) AS total_rows,
           count(*) FILTER (skip_reason = 'none') AS processed,
           count(*) FILTER (skip_reason <> 'none') AS skipped
    FROM triaged GROUP BY source_file)"""

PROFILE = f"""{TRIAGED}, grouped AS (
    SELECT source_file, count(*) AS total_rows,
           count(*) FILTER (skip_reason <> 'none') / CAST(count(*) AS DOUBLE) AS empty_rate,
           CAST(coalesce(floor(avg(length(text)) FILTER (skip_reason = 'none')), 0) AS BIGINT) AS avg_text_length,
           CAST(coalesce(max(length(text)) FILTER (skip_reason = 'none'), 0) AS BIGINT) AS max_text_length,
           count(*) FILTER (skip_reason = 'empty') AS n_empty,
           count(*) FILTER (skip_reason = 'whitespace') AS n_whitespace,
           count(*) FILTER (skip_reason = 'nan') AS n_nan,
           count(*) FILTER (skip_reason = 'non_text') AS n_non_text
    FROM triaged GROUP BY source_file),
  profile AS (
    SELECT source_file,
           CASE WHEN empty_rate > 0.1 OR max_text_length > 5000 THEN 'warning' ELSE 'valid' END AS status,
           total_rows, empty_rate, avg_text_length, max_text_length,
           n_empty, n_whitespace, n_nan, n_non_text,
           concat_ws('|', CASE WHEN empty_rate > 0.1 THEN 'empty_rate' END,
                     CASE WHEN n_empty > 0 THEN 'empty' END,
                     CASE WHEN n_whitespace > 0 THEN 'whitespace' END,
                     CASE WHEN n_nan > 0 THEN 'nan' END,
                     CASE WHEN n_non_text > 0 THEN 'non_text' END,
                     CASE WHEN max_text_length > 5000 THEN 'long_text' END) AS issues
    FROM grouped)"""

CATEGORY_SUMMARY = f"""{TAGGED}, known(idx, category) AS (
    VALUES (0, 'unused'), (1, 'toxic'), (2, 'quality'), (3, 'fr'), (4, 'de')),
  found AS (SELECT category, count(*) AS n
            FROM (SELECT unnest(labels) AS category FROM tagged) GROUP BY category),
  summary AS (SELECT CAST(k.idx AS BIGINT) AS idx, k.category, coalesce(f.n, 0) AS n,
                     coalesce(f.n, 0) * 100.0::DOUBLE / (SELECT count(*) FROM tagged) AS pct
              FROM known k LEFT JOIN found f ON f.category = k.category)"""


def trials(test: float, valid: float) -> str:
    """CTEs of a fit with five smoothing values, up to ``made``: the trials before the stop."""
    alphas = (4.0, 2.0, 1.0, 0.5, 0.25)
    tail = " UNION ALL ".join(f"SELECT {i} AS step, {a}::DOUBLE AS alpha" for i, a in enumerate(alphas))
    p = "((coalesce(dfl, 0) + alpha) / (nl + 2 * alpha))"
    q = "((df - coalesce(dfl, 0) + alpha) / (total - nl + 2 * alpha))"
    return f"""{LABELLED}, {split('labelled', test, valid)},
    training AS (SELECT * FROM parts WHERE split = 'train'),
    {counts('training')},
    every_label AS (SELECT DISTINCT unnest(labels) AS label FROM labelled),
    names AS (SELECT e.label, coalesce(l.nl, 0) AS nl FROM every_label e LEFT JOIN n_label l ON e.label = l.label),
    alphas AS ({tail}),
    weights AS (SELECT a.step, t.token, v.label,
                  CAST(round(ln({p} * (1 - {q}) / ({q} * (1 - {p}))) * 1000000) AS BIGINT) AS weight,
                  CAST(round(ln((1 - {p}) / (1 - {q})) * 1000000) AS BIGINT) AS absent
                FROM alphas a CROSS JOIN df_token t CROSS JOIN names v CROSS JOIN n_docs n
                LEFT JOIN df_pair c ON c.token = t.token AND c.label = v.label WHERE t.df >= 2),
    bias AS (SELECT a.step, v.label,
                  CAST(round(ln((v.nl + alpha) / (n.total - v.nl + alpha)) * 1000000) AS BIGINT)
                  + coalesce(w.s, 0) AS b
             FROM alphas a CROSS JOIN names v CROSS JOIN n_docs n
             LEFT JOIN (SELECT step, label, CAST(sum(absent) AS BIGINT) AS s FROM weights GROUP BY step, label) w
             ON w.step = a.step AND w.label = v.label),
    {trial_cells('validation', 'validation_cells')},
    f AS (SELECT step, coalesce(2.0::DOUBLE * sum(y * g)
                 / nullif(2 * sum(y * g) + sum((1 - y) * g) + sum(y * (1 - g)), 0), 0) AS micro_f1
          FROM validation_cells GROUP BY step),
    judged AS (SELECT step, micro_f1, micro_f1 > coalesce(max(micro_f1) OVER (ORDER BY step
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS improved FROM f),
    stops AS (SELECT step, NOT improved AND NOT lag(improved, 1, true) OVER (ORDER BY step) AS stop FROM judged),
    made AS (SELECT CAST(j.step AS BIGINT) AS step, a.alpha, round(j.micro_f1, 6) AS micro_f1, j.improved
             FROM judged j JOIN alphas a ON a.step = j.step
             WHERE NOT EXISTS (SELECT 1 FROM stops s WHERE s.stop AND s.step < j.step))"""


def trial_cells(part: str, name: str) -> str:
    """CTE ``name``: truth and guess of every trial for the rows of one part of the split."""
    return f"""{name} AS (
        SELECT b.step, b.label, v.doc_id, CAST(list_contains(v.labels, b.label) AS INT) AS y,
               CAST(coalesce(s.s, 0) + b.b >= 0 AS INT) AS g
        FROM (SELECT * FROM parts WHERE split = '{part}') v CROSS JOIN bias b
        LEFT JOIN (SELECT w.step, r.doc_id, w.label, CAST(sum(w.weight) AS BIGINT) AS s
                   FROM (SELECT doc_id, unnest(list_distinct({TOKENS})) AS token
                         FROM parts WHERE split = '{part}') r
                   JOIN weights w ON r.token = w.token GROUP BY w.step, r.doc_id, w.label) s
        ON s.step = b.step AND s.doc_id = v.doc_id AND s.label = b.label)"""


WIDE = ", ".join(
    f"round(coalesce(max(prob) FILTER (label = '{name}'), 0), 6) AS {name}"
    for name in ("de", "en", "es", "fr", "quality", "toxic", "unknown")
)

METRICS = f"""SELECT
    round(coalesce(2.0::DOUBLE * sum(tp) / nullif(2 * sum(tp) + sum(fp) + sum(fn), 0), 0), 6) AS micro_f1,
    round(avg({F1}), 6) AS macro_f1,
    round(coalesce(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fp), 0), 0), 6) AS micro_precision,
    round(coalesce(sum(tp)::DOUBLE / nullif(sum(tp) + sum(fn), 0), 0), 6) AS micro_recall,
    round(max(exact_match), 6) AS exact_match
    FROM per_label, exact"""

ORACLE_SQL: dict[str, str] = {
    "skip_reason_rows": f"WITH {TRIAGED} SELECT doc_id, skip_reason, skip_reason <> 'none' AS skip FROM triaged",
    "skip_reason_counts": f"WITH {TRIAGED} SELECT skip_reason, count(*) AS n FROM triaged GROUP BY skip_reason",
    "skip_reason_share_by_file": f"""WITH {TRIAGED}
        SELECT source_file, skip_reason, count(*) AS n,
               count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY source_file) AS pct
        FROM triaged GROUP BY source_file, skip_reason""",
    "skip_summary_by_file": f"""WITH {TRIAGED}, c AS (
          SELECT source_file, skip_reason || '=' || CAST(count(*) AS VARCHAR) AS pair
          FROM triaged WHERE skip_reason <> 'none' GROUP BY source_file, skip_reason)
        SELECT source_file, string_agg(pair, ', ' ORDER BY pair) AS summary FROM c GROUP BY source_file""",
    "skip_reason_variant": """SELECT event_id, CASE event_type WHEN 'error' THEN 'empty' WHEN 'view' THEN 'none'
          WHEN 'purchase' THEN CASE WHEN value > 50 THEN 'nan' ELSE 'whitespace' END
          ELSE 'non_text' END AS skip_reason FROM events""",
    "skip_reason_number": """SELECT event_id,
          CASE WHEN value IS NULL OR isnan(value) THEN 'nan' ELSE 'non_text' END AS skip_reason FROM events""",
    "valid_texts": f"""WITH {TRIAGED} SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars
        FROM triaged WHERE skip_reason = 'none'""",
    "text_functions": f"""SELECT doc_id, md5({strip('padded')}) AS stripped, md5(lower({strip('padded')})) AS lowered,
          CAST(length({strip('padded')}) AS BIGINT) AS n_chars
        FROM (SELECT doc_id, chr(160) || chr(9) || ' ' || text || ' ' || chr(8195) || chr(10) || chr(133) AS padded
              FROM documents)""",
    "file_profile": f"WITH {PROFILE} SELECT * FROM profile",
    "file_status_rollup": f"""WITH {PROFILE}
        SELECT s.status, count(p.status) AS n FROM (VALUES ('valid'), ('warning'), ('error')) s(status)
        LEFT JOIN profile p ON p.status = s.status GROUP BY s.status""",
    "strict_input_check": f"""WITH {COMMENTS}
        SELECT count(*) AS total_rows, count(*) FILTER (text IS NULL) AS null_texts,
               CAST(coalesce(max(length(text)), 0) AS BIGINT) AS max_length,
               count(*) FILTER (text IS NULL) = 0 AND coalesce(max(length(text)), 0) <= 5000 AS passed
        FROM comments""",
    "preview": "SELECT doc_id, lang, md5(text) AS text_md5 FROM documents ORDER BY doc_id LIMIT 10",
    "parse_labels": f"WITH {CELLS} SELECT doc_id, array_to_string({PARSED}, '~') AS labels FROM cells",
    "combine_category_columns": """SELECT doc_id, concat_ws('|', CASE WHEN lang <> 'en' THEN 'x' END,
          CASE WHEN n_chars > 1000 THEN source END, lang) AS labels FROM documents""",
    "combine_pattern_columns": """SELECT doc_id, concat_ws('|', source,
          CASE WHEN n_chars > 1000 THEN 'long' END) AS labels FROM documents""",
    "labels_to_wide": f"""WITH {LABELLED} SELECT doc_id, coalesce(labels[1], '') AS "Category 1",
          coalesce(labels[2], '') AS "Category 2", coalesce(labels[3], '') AS "Category 3" FROM labelled""",
    "widest_label_list": f"WITH {LABELLED} SELECT CAST(max(len(labels)) AS BIGINT) AS k FROM labelled",
    "label_vocabulary": f"""WITH {LABELLED}, v AS (SELECT DISTINCT unnest(labels) AS label FROM labelled)
        SELECT row_number() OVER (ORDER BY label) - 1 AS idx, label FROM v""",
    "multi_hot": f"""WITH {LABELLED}, v AS (SELECT list(DISTINCT label ORDER BY label) AS names
          FROM (SELECT unnest(labels) AS label FROM labelled))
        SELECT doc_id, array_to_string(list_transform(names,
               lambda x: CASE WHEN list_contains(labels, x) THEN '1' ELSE '0' END), ',') AS labels_multi
        FROM labelled, v""",
    "label_counts": f"""WITH {LABELLED} SELECT label, count(*) AS n
        FROM (SELECT unnest(labels) AS label FROM labelled) GROUP BY label ORDER BY n DESC, label""",
    "rare_labels": f"""WITH {LABELLED} SELECT label, count(*) AS n
        FROM (SELECT unnest(labels) AS label FROM labelled) GROUP BY label HAVING count(*) < 100""",
    "label_imbalance": f"""WITH {LABELLED}, c AS (SELECT label, count(*) AS n
          FROM (SELECT unnest(labels) AS label FROM labelled) GROUP BY label)
        SELECT count(*) AS n_labels, max(n) AS most, min(n) AS least,
               max(n) / CAST(min(n) AS DOUBLE) AS ratio FROM c""",
    "duplicate_texts": f"WITH {COMMENTS} {text_facts('comments')}",
    "training_gate": f"WITH {LABELLED}, {gate('labelled')} SELECT {RULE_COLUMNS} FROM rules",
    "training_gate_verdict": f"""WITH {COMMENTS}, {LABELLED},
        dirty AS (SELECT c.doc_id, c.text, l.labels FROM comments c JOIN labelled l ON c.doc_id = l.doc_id),
        {gate('dirty')},
        stop AS (SELECT rule FROM rules WHERE severity = 'error' AND NOT passed ORDER BY position LIMIT 1)
        SELECT NOT EXISTS (SELECT 1 FROM stop) AS is_valid, (SELECT rule FROM stop) AS failed_rule""",
    "light_gate": f"""WITH {COMMENTS}, f AS (SELECT count(*) AS r, count(*) FILTER (text IS NULL) AS nt,
          count(*) FILTER (lang IS NULL) AS nl FROM comments),
        rules(position, rule, severity, observed, limit_value, passed) AS (
          SELECT 1, 'not_empty', 'error', r, 1, r > 0 FROM f UNION ALL
          SELECT 2, 'no_null_text', 'error', nt, 0, nt = 0 FROM f UNION ALL
          SELECT 3, 'no_null_labels', 'error', nl, 0, nl = 0 FROM f UNION ALL
          SELECT 4, 'enough_rows', 'error', r, 10, r >= 10 FROM f)
        SELECT {RULE_COLUMNS} FROM rules""",
    "training_recommendations": f"""WITH {LABELLED}, f AS ({text_facts('labelled')}),
        a(position, advice, n, applies) AS (
          SELECT 1, 'remove_duplicates', duplicates, duplicates > 0 FROM f UNION ALL
          SELECT 2, 'review_short_texts', short_texts, short_texts > 0 FROM f UNION ALL
          SELECT 3, 'review_long_texts', long_texts, long_texts > 0 FROM f UNION ALL
          SELECT 4, 'small_dataset', total_rows, total_rows < 100 FROM f UNION ALL
          SELECT 5, 'moderate_dataset', total_rows, total_rows BETWEEN 100 AND 499 FROM f)
        SELECT CAST(position AS BIGINT) AS position, advice, n FROM a WHERE applies""",
    "split_assign": f"WITH ids AS (SELECT doc_id FROM documents), {split('ids', 0.1, 0.1)} SELECT doc_id, split FROM parts",
    "sizes_of_split": f"WITH {LABELLED}, {split('labelled', 0.15, 0.15)} SELECT split, count(*) AS n FROM parts GROUP BY split",
    "shuffled_rows": """SELECT doc_id, lang, md5('42:' || CAST(doc_id AS VARCHAR)) AS hash FROM documents
        ORDER BY hash, doc_id""",
    "chunk_offsets": """WITH c AS (SELECT event_type,
            (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) // 1000 AS chunk FROM events)
        SELECT event_type, chunk, chunk * 1000 AS start_row, count(*) AS n_rows FROM c GROUP BY event_type, chunk""",
    "chunk_rows": """WITH c AS (SELECT event_id, event_type,
            row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS row_pos FROM events)
        SELECT event_id, event_type, row_pos, row_pos // 1000 AS chunk FROM c""",
    "tokenize_truncate": f"""WITH k AS (SELECT doc_id, {TOKENS}[1:128] AS toks FROM documents)
        SELECT doc_id, CAST(len(toks) AS BIGINT) AS n_tokens,
               array_to_string(list_concat(toks, list_transform(range(128 - len(toks)), lambda i: '_')), ' ') AS tokens,
               repeat('1', len(toks)) || repeat('0', 128 - len(toks)) AS mask FROM k""",
    "token_label_counts": f"""WITH {LABELLED}, {counts('labelled')}
        SELECT '(document)' AS token, '(any)' AS label, total AS n FROM n_docs UNION ALL
        SELECT '(document)', label, nl FROM n_label UNION ALL
        SELECT token, '(any)', df FROM df_token UNION ALL
        SELECT token, label, dfl FROM df_pair""",
    "nb_weights": f"WITH {FIT} SELECT token, df, label, weight FROM weights",
    "nb_bias": f"WITH {FIT} SELECT label, b AS bias FROM bias",
    "nb_scores": f"""WITH {TRIAGED}, {FIT}, {scores('triaged')}
        SELECT doc_id, skip_reason, label, round(prob, 6) AS prob FROM scored""",
    "scored_rows": f"""WITH {TRIAGED}, {FIT}, {scores('triaged')}
        SELECT s.doc_id, t.lang, {WIDE}, s.skip_reason
        FROM scored s JOIN triaged t ON s.doc_id = t.doc_id GROUP BY s.doc_id, t.lang, s.skip_reason""",
    "nb_predictions": f"""WITH {TRIAGED}, {FIT}, {scores('triaged')}
        SELECT doc_id, {PREDICTED} FROM scored GROUP BY doc_id""",
    "refine_weights": f"WITH {FIT} SELECT token, df, label, weight FROM weights",
    "test_metrics": f"""WITH {LABELLED}, {split('labelled', 0.3, 0.0)},
        training AS (SELECT * FROM parts WHERE split = 'train'),
        testing AS (SELECT *, 'none' AS skip_reason FROM parts WHERE split = 'test'),
        {counts('training')}, {weights()}, {scores('testing')}, {confusion('testing')} {METRICS}""",
    "label_metrics": f"""WITH {FIT}, every AS (SELECT *, 'none' AS skip_reason FROM labelled),
        {scores('every')}, {confusion('every')}
        SELECT label, tp, fp, fn, round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS "precision",
               round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall, round({F1}, 6) AS f1
        FROM per_label""",
    "early_stop_choice": f"WITH {trials(0.0, 0.3)} SELECT * FROM made",
    "training_run": f"""WITH {trials(0.3, 0.3)}, {trial_cells('test', 'test_cells')},
        best AS (SELECT step, alpha FROM made WHERE improved ORDER BY step DESC LIMIT 1),
        cells_m AS (SELECT c.* FROM test_cells c JOIN best ON c.step = best.step),
        {CONFUSION},
        sizes AS (SELECT count(*) FILTER (split = 'train') AS n_train,
                         count(*) FILTER (split = 'validation') AS n_validation,
                         count(*) FILTER (split = 'test') AS n_test FROM parts)
        SELECT * FROM (SELECT alpha FROM best), ({METRICS}), sizes""",
    "model_versions": f"""WITH {LABELLED}, {counts('labelled')},
        names AS (SELECT string_agg(label, '|' ORDER BY label) AS labels FROM n_label)
        SELECT CAST(1 AS BIGINT) AS version, labels, (SELECT count(*) FROM df_token WHERE df >= 2) AS n_tokens FROM names
        UNION ALL SELECT 2, labels, (SELECT count(*) FROM df_token) FROM names""",
    "published_versions": """SELECT CAST(1 AS BIGINT) AS version, source AS name, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars
        FROM documents GROUP BY source UNION ALL
        SELECT 2, lang, count(*), CAST(sum(n_chars) AS BIGINT) FROM documents GROUP BY lang""",
    "lr_balance": f"""WITH {LABELLED}, valid AS (SELECT * FROM labelled WHERE ({reason()}) = 'none'),
        names AS (SELECT DISTINCT unnest(labels) AS label FROM valid)
        SELECT label, count(*) AS n_rows, count(*) FILTER (list_contains(labels, label)) AS n_positive, true AS balanced,
               true AS better_than_share
        FROM names CROSS JOIN valid GROUP BY label""",
    "external_scores": f"""WITH {TRIAGED}
        SELECT doc_id, skip_reason,
               CASE WHEN skip_reason = 'none' THEN round(1 / (1 + exp(-least((length(text) - 1000) / 1000.0::DOUBLE, 60))), 6) ELSE 0 END AS "long",
               CASE WHEN skip_reason = 'none' THEN round(1 / (1 + exp(-greatest((500 - length(text)) / 100.0::DOUBLE, -60))), 6) ELSE 0 END AS "short",
               0.0::DOUBLE AS unserved
        FROM triaged""",
    "external_predictions": """SELECT doc_id, concat_ws('|', CASE WHEN length(text) >= 1000 THEN 'long' END,
               CASE WHEN length(text) <= 500 THEN 'short' END) AS predicted FROM documents""",
    "run_summary": f"""WITH {TAGGED}, s AS (SELECT count(*) AS total_comments, CAST(sum(len(labels)) AS BIGINT) AS total_labels,
          count(*) FILTER (len(labels) = 0) AS skipped_count FROM tagged)
        SELECT *, total_labels / CAST(greatest(total_comments - skipped_count, 1) AS DOUBLE) AS avg_labels FROM s""",
    "category_counts": f"""WITH {TAGGED} SELECT category, count(*) AS n
        FROM (SELECT unnest(labels) AS category FROM tagged) GROUP BY category""",
    "category_summary": f"WITH {CATEGORY_SUMMARY} SELECT * FROM summary",
    "category_top5": f"""WITH {CATEGORY_SUMMARY}
        SELECT row_number() OVER (ORDER BY n DESC, idx) AS rank, category, n, pct
        FROM summary WHERE n > 0 ORDER BY n DESC, idx LIMIT 5""",
    "file_results": f"WITH {FILE_RESULTS} SELECT * FROM results",
    "batch_summary": f"""WITH {FILE_RESULTS}
        SELECT count(*) AS total_files, count(*) AS successful_files, CAST(0 AS BIGINT) AS failed_files,
               100.0::DOUBLE AS success_rate, CAST(sum(total_rows) AS BIGINT) AS total_rows,
               CAST(sum(processed) AS BIGINT) AS processed_comments,
               CAST(sum(skipped) AS BIGINT) AS skipped_comments FROM results""",
    "per_file_skips": f"""WITH {FILE_RESULTS}
        SELECT source_file, total_rows, skipped, skipped * 100.0::DOUBLE / total_rows AS skipped_pct
        FROM results WHERE skipped > 0 ORDER BY skipped DESC, source_file""",
    "combined_output": """SELECT 'documents' AS source_file, doc_id, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn,
            NULL::VARCHAR AS role, lang, md5(text) AS text_md5 FROM documents
        UNION ALL SELECT 'conversations', NULL, conv_id, turn, role, NULL, md5(text) FROM conversations""",
    "file_precheck": """SELECT 'documents.parquet' AS source_file, 'ok' AS status, count(*) AS n_rows FROM documents
        UNION ALL SELECT 'conversations.parquet', 'ok', count(*) FROM conversations
        UNION ALL SELECT 'benchmark.parquet', 'ok', count(*) FROM benchmark
        UNION ALL SELECT 'labels.parquet', 'missing_column', count(*) FROM labels
        UNION ALL SELECT 'absent.parquet', 'not_found', 0
        UNION ALL SELECT 'folder.parquet', 'ok', count(*) FROM documents""",
    "csv_records": """SELECT 'returns' AS file, lang AS text, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_misfits
        FROM documents GROUP BY lang
        UNION ALL SELECT 'surplus', lang, count(*), count(*) FILTER (doc_id % 10 = 0) FROM documents GROUP BY lang""",
    "file_names": """SELECT 'documents' AS stem, '.parquet' AS suffix,
            'classified_documents_20240102_030405' AS output, count(*) AS n FROM documents""",
    "csv_scan": f"""WITH {COMMENTS}, c AS (SELECT doc_id, lang, nullif(text, '') AS text FROM comments)
        SELECT doc_id, lang, {reason(null_reason='nan')} AS skip_reason, md5(text) AS text_md5 FROM c""",
    "csv_spanning_scan": f"""WITH {COMMENTS}, c AS (SELECT doc_id, lang, nullif(text, '') AS text FROM comments)
        SELECT doc_id, lang, md5(text) AS text_md5,
               CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS line_ends, false AS misfit FROM c""",
    "csv_encodings": "SELECT 'utf-8' AS encoding, count(*) AS n_rows FROM documents",
    "labelled_scan": f"""WITH {LABELLED}
        SELECT doc_id, md5(text) AS text_md5, array_to_string(labels, '|') AS labels FROM labelled""",
    "canonical_table": """SELECT doc_id, 'text' AS form, md5(CASE WHEN doc_id % 7 > 0 THEN coalesce(text, '') ELSE '' END) AS text_md5,
               coalesce(lang, '') AS labels FROM documents
        UNION ALL SELECT doc_id, 'number', md5(coalesce(CAST(n_chars AS VARCHAR), '')), coalesce(lang, '') FROM documents""",
    "required_columns": """SELECT 'documents' AS table_name, count(*) AS n_rows, CAST(NULL AS VARCHAR) AS message FROM documents
        UNION ALL SELECT 'conversations', 0, 'missing column(s): doc_id'
        UNION ALL SELECT 'benchmark', 0, 'missing column(s): doc_id'
        UNION ALL SELECT 'labels', 0, 'missing column(s): text'""",
    "labelled_surplus": """SELECT doc_id, 'a, "b"' || n_chars AS text, lang AS labels,
          CASE WHEN doc_id % 10 = 0 THEN doc_id || ',"a, ""b""' || n_chars || '",' || lang || ',' || source END AS surplus
        FROM documents""",
    "batch_run": f"""WITH {TRIAGED}
        SELECT CAST(1 AS BIGINT) AS not_found, count(*) AS total_rows,
               count(*) FILTER (skip_reason = 'none') AS processed,
               count(*) FILTER (skip_reason <> 'none') AS skipped FROM triaged""",
    "dry_run": """WITH f AS (SELECT 'documents.parquet' AS file, text FROM documents
          UNION ALL SELECT 'conversations.parquet', text FROM conversations
          UNION ALL SELECT 'benchmark.parquet', text FROM benchmark)
        SELECT file, CASE WHEN max(length(text)) > 5000 THEN 'warning' ELSE 'valid' END AS status,
               count(*) AS total_rows, 0.0::DOUBLE AS empty_rate,
               CAST(floor(avg(length(text))) AS BIGINT) AS avg_text_length,
               CAST(max(length(text)) AS BIGINT) AS max_text_length, 'unknown' AS encoding, true AS has_size,
               CASE WHEN max(length(text)) > 5000 THEN 'long_text' ELSE '' END AS issues, NULL::VARCHAR AS error
        FROM f GROUP BY file
        UNION ALL SELECT 'labels.parquet', 'error', 0, 0, 0, 0, 'unknown', true, NULL, 'missing_column'
        UNION ALL SELECT 'absent.parquet', 'error', 0, 0, 0, 0, 'unknown', NULL, NULL, 'not_found'""",
    "inference_run": f"""WITH {CLEAN}, {FIT}, {scores('clean')},
        names AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM n_label)
        SELECT n.idx, n.label AS category, count(s.label) FILTER (s.prob >= 0.5) AS n,
               count(s.label) FILTER (s.prob >= 0.5) * 100.0::DOUBLE / (SELECT count(*) FROM documents) AS pct
        FROM names n JOIN scored s ON s.label = n.label GROUP BY n.idx, n.label""",
    "stream_skip_counts": f"WITH {TRIAGED} SELECT skip_reason, count(*) AS n FROM triaged GROUP BY skip_reason",
    "stream_category_counts": f"""WITH {TAGGED} SELECT category, count(*) AS n
        FROM (SELECT unnest(labels) AS category FROM tagged) GROUP BY category""",
    "stream_progress": "SELECT count(*) AS streamed, count(*) AS observed FROM documents",
    "stream_quarantine": """WITH lines AS (SELECT doc_id % 10 = 0 AND lang IS NOT NULL AS beyond,
            CONCAT(doc_id, ',"a, ""b""', n_chars, '",', lang) AS record FROM documents)
        SELECT 'good' AS folder, 'ok' AS status, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_surplus, count(*) AS published,
               NULL AS record_md5 FROM documents
        UNION ALL SELECT 'surplus', 'ok', count(*) FILTER (NOT beyond), count(*) FILTER (beyond), count(*) FILTER (NOT beyond),
               max(md5(record)) FILTER (beyond) FROM lines
        UNION ALL SELECT 'lacking', 'missing_column', 0, 0, 0, NULL""",
    "stream_classify_csv": f"""WITH {COMMENTS}, c AS (SELECT doc_id, nullif(text, '') AS text FROM comments),
        arrived AS (SELECT doc_id, text, {reason(null_reason='nan')} AS skip_reason FROM c), {FIT}, {scores('arrived')}
        SELECT doc_id, skip_reason, {PREDICTED} FROM scored GROUP BY doc_id, skip_reason""",
    "chunk_rows_text_key": """WITH c AS (SELECT 'e' || CAST(event_id AS VARCHAR) AS event_key, event_type FROM events),
        p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_key) - 1 AS row_pos FROM c)
        SELECT event_key, event_type, row_pos, row_pos // 100 AS chunk FROM p""",
    "stream_classify": f"""WITH {CLEAN}, {FIT}, {scores('clean')}
        SELECT doc_id, skip_reason, {PREDICTED} FROM scored GROUP BY doc_id, skip_reason""",
    "predicted_categories": f"""WITH {TRIAGED}, {FIT}, {scores('triaged')},
        names AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM n_label)
        SELECT n.idx, n.label AS category, count(s.label) FILTER (s.prob >= 0.5) AS n,
               count(s.label) FILTER (s.prob >= 0.5) * 100.0::DOUBLE / (SELECT count(*) FROM documents) AS pct
        FROM names n JOIN scored s ON s.label = n.label GROUP BY n.idx, n.label""",
}

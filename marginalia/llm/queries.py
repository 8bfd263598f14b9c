"""The queries of the operators over the given tables, and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    decontaminate,
    fingerprint,
    language_id,
    license_scan,
    lm_score,
    merkle,
    near_dedup,
    packing,
    quality_rank,
    suffix_dedup,
    toxicity,
    url_filter,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def decontamination_columns(found: DataFrame) -> DataFrame:
    """The digest of ``decontaminate.contamination`` and the verdict: at least a twentieth is hit."""
    ids = F.array_sort(F.col("items").cast("array<string>"))
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


@query
def op4_decontamination(spark, sf_dir):
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination_columns(decontaminate.contamination(documents, items))


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op4_decontamination"] = rf"""
WITH iw AS (
  SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), starts AS (
  SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 12, least(len(w), 1)))) AS s FROM iw
), win AS (
  SELECT DISTINCT item_id, len(w[s:s+12]) AS n, array_to_string(w[s:s+12], ' ') AS win FROM starts
), dw AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), spots AS (
  SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM dw, (SELECT DISTINCT n FROM win)
), hit AS (
  SELECT DISTINCT doc_id, s, spots.n, item_id FROM spots JOIN win ON win = array_to_string(w[s:s+spots.n-1], ' ')
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY 1
), it AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hit GROUP BY 1
)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM dw d LEFT JOIN pos ON pos.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""


@query
def op5_near_dedup(spark, sf_dir):
    found = near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4)
    return found.select(
        F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept"
    )


SQL["op5_near_dedup"] = rf"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s+3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 3, least(len(w), 1)))) AS s FROM dw)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), link AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * c >= 80 * (p.n + q.n - c)
), edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION
  SELECT reach.x, edge.y FROM reach JOIN edge ON edge.x = reach.y
), low AS (
  SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN low ON low.doc_id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""


@query
def op7_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.repeated_spans(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["to"] - s["from"])
    return found.select(
        F.col("doc").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def tokenizer_path() -> str:
    """Vocabulary file of the packing query; ``WORD_VOCABULARY`` in the environment names another."""
    import public_tokenizers

    return os.environ.get("WORD_VOCABULARY") or public_tokenizers.path("word_bpe_49k.json")


def packed_columns(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        F.col("doc").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens",
        F.col("sequence").alias("sequence_id"), "offset",
    )


@query
def op8_packing(spark, sf_dir):
    return packed_columns(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path()))


def learnt_languages(documents: DataFrame) -> language_id.Network | None:
    """Fitted on the documents that are not held out."""
    return language_id.fit(documents.filter(language_id.remainder("doc_id", 4) != 2))


@query
def op10_language_id(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(documents.select("doc_id", "text"), learnt_languages(documents))
    return found.select(
        "row.doc_id",
        F.coalesce(language_id.remainder("row.doc_id", 4) == 2, F.lit(False)).alias("held_out"),
        F.col("language").alias("lang_pred"),
        "score",
    )


@query
def op9_fingerprint(spark, sf_dir):
    return fingerprint.fingerprints(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


@query
def op6_toxicity(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(language_id.remainder("doc_id", 3) == 1, F.lit(False))
    model = toxicity.fit(documents, labels.filter(~held_out))
    scored = toxicity.toxicity(documents, model).withColumnRenamed("doc", "doc_id")
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


@query
def op13_quality(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    held_out = F.coalesce(language_id.remainder("doc_id", 5) == 0, F.lit(False))
    model = quality_rank.fit(documents, labels.filter(~held_out))
    scored = quality_rank.quality(documents, model).withColumnRenamed("doc", "doc_id")
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_rank.CUT).cast("int").alias("predicted")
    )


@query
def op11_whitening(spark, sf_dir):
    """A deviation beyond a long is null."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


@query
def op12_merkle_manifest(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    ids = F.col("doc_id")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    changed = F.coalesce(F.crc32(ids.cast("string")) % 5 == 0, F.lit(False))
    text = F.when(changed, lowered).otherwise(F.col("text"))
    keep = {"doc_id": ids, "tampered": merkle.leaf({"text": text})}
    found = merkle.manifest(documents, keep=keep).proofs("doc_id", "tampered")
    folded = found.withColumn("folded_root", merkle.fold(F.col("tampered"), F.col("path")))
    return folded.select(
        "doc_id",
        F.col("hash").alias("leaf"),
        "subroot",
        "root",
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def _merkle_sql() -> str:
    def tree(name: str, leaves: str) -> str:
        """Levels ``name`` of the nodes (k, idx, n, h), and the siblings of every node."""
        return f"""{name} AS (
  SELECT k, 0 AS lvl, idx, n, h FROM {leaves}
  UNION ALL
  SELECT k, lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM {name} WHERE n > 1 GROUP BY k, lvl, idx // 16, n
), {name}_sib AS (
  SELECT k, lvl, idx, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name} WHERE n > 1 WINDOW w AS (PARTITION BY k, lvl, idx // 16 ORDER BY idx)
)"""

    def climb(name: str, levels: str, start: str) -> str:
        """Folded digests and proofs of the rows ``start`` (id, k, idx, h, p) at the top of their tree."""
        return f"""{name}_steps AS (
  SELECT id, k, 0 AS lvl, idx, h, p FROM {start}
  UNION ALL
  SELECT id, s.k, s.lvl + 1, s.idx // 16, sha256(l || s.h || r), p || l || r
  FROM {name}_steps s JOIN {levels}_sib b ON b.k = s.k AND b.lvl = s.lvl AND b.idx = s.idx
), {name} AS (
  SELECT id, k, arg_max(h, lvl) AS h, arg_max(p, lvl) AS p FROM {name}_steps GROUP BY 1, 2
)"""

    def encoded(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode({x}::VARCHAR)) || ':' || {x}::VARCHAR END"

    fields = " || ".join(encoded(c) for c in ("doc_id", "source", "lang", "n_chars"))
    bits = "list_reduce(list_concat([xor(a, b)], [0::BIGINT for i in range(8)]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    bytes_of = "list_transform(range(length(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT)"
    crc = f"xor(list_reduce(list_concat([4294967295], {bytes_of}), lambda a, b: {bits}), 4294967295)"
    return f"""
WITH RECURSIVE src AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || source, '') AS k, sha256({fields} || {encoded("text")}) AS h,
         sha256({fields} || {encoded(f"CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {_LOWERED} ELSE text END")}) AS t FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY k) AS n FROM src
), {tree("low", "leaves")}, subs AS (
  SELECT k AS grp, '' AS k, h, row_number() OVER (ORDER BY low.k) - 1 AS idx, count(*) OVER () AS n FROM low WHERE n = 1
), {tree("top", "subs")}, begun AS (
  SELECT id, k, idx, t AS h, '' AS p FROM leaves
), {climb("half", "low", "begun")}, middle AS (
  SELECT id, subs.k, idx, half.h, p FROM half JOIN subs ON grp = half.k
), {climb("whole", "top", "middle")}
SELECT doc_id, leaves.h AS leaf, subs.h AS subroot, top.h AS root, sha256(whole.p) AS proof_sha256,
       whole.h AS folded_root, whole.h = top.h AS verified
FROM leaves JOIN whole ON whole.id = leaves.id JOIN subs ON grp = leaves.k JOIN top ON top.n = 1
"""


SQL["op12_merkle_manifest"] = _merkle_sql()


@query
def op3_license_scan(spark, sf_dir):
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("doc").alias("doc_id"),
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join("matches.name", ",").alias("licenses"),
        F.round(F.array_max("matches.containment"), 6).alias("best"),
        F.array_min("matches.from").alias("first_word"),
    )


@query
def op2_lm_score(spark, sf_dir):
    return lm_score.score(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


URL_RULES = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]


@query
def op1_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.parsed_rules(URL_RULES)).withColumnRenamed("page", "page_id")


def _url_sql() -> str:
    """The same model in SQL, order by order."""
    parts = [
        r"""
u AS (SELECT row_number() OVER () AS row, page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END, '') AS rest FROM pages),
hp AS (SELECT row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) r(v, h, p)),
b AS (SELECT row, page_id, host, path, host || path AS txt, substr(md5(host || path), 1, 1) IN ('0', '1', '2') AS held,
  arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS rv
  FROM hp LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL),
s AS (SELECT row, held, rv, substr(repeat(chr(2), 4) || txt, i, 5) AS g FROM (SELECT *, unnest(generate_series(1, length(txt))) AS i FROM b)),
g AS (SELECT g, count(*) FILTER (NOT held AND rv = 'allow') AS a, count(*) FILTER (NOT held AND rv = 'block') AS r FROM s GROUP BY 1)"""
    ]
    for k in range(5):
        p = [f"p{k - 1}.{c}" if k else "(1.0 / 256)::DOUBLE" for c in "ar"]
        before = f"JOIN p{k - 1} ON p{k - 1}.o = right(o{k}.o, {k})" if k else ""
        probability = [
            f"CASE WHEN n{c} > 0 THEN (o{k}.{c}::DOUBLE + t{c}::DOUBLE * {q}) / (n{c} + t{c})::DOUBLE ELSE {q} END AS {c}"
            for c, q in zip("ar", p, strict=True)
        ]
        parts.append(
            f"""
o{k} AS (SELECT right(g, {k + 1}) AS o, sum(a)::BIGINT AS a, sum(r)::BIGINT AS r FROM g GROUP BY 1),
c{k} AS (SELECT left(o, {k}) AS c, sum(a)::BIGINT AS na, sum(r)::BIGINT AS nr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM o{k} GROUP BY 1),
p{k} AS (SELECT o{k}.o, {", ".join(probability)} FROM o{k} JOIN c{k} ON c{k}.c = left(o{k}.o, {k}) {before})"""
        )
    parts.append(
        """
tot AS (SELECT sum(a) > 0 AND sum(r) > 0 AS known FROM g),
w AS (SELECT o, CASE WHEN known THEN round((ln(a) - ln(r)) * 1e6)::BIGINT ELSE 0 END AS w FROM p4, tot),
sc AS (SELECT b.row, b.page_id, b.host, b.path, b.rule, b.rv, b.held, coalesce(round(sum(w)::DOUBLE / count(g)::DOUBLE)::BIGINT, 0) AS score
  FROM b LEFT JOIN s ON s.row = b.row LEFT JOIN w ON w.o = s.g GROUP BY ALL),
bins AS (SELECT greatest(-2000, least(2000, floor(score / 10000.0)::BIGINT)) AS bin, count(*) FILTER (rv = 'allow') AS a, count(*) FILTER (rv = 'block') AS r
  FROM sc WHERE held AND rv IS NOT NULL GROUP BY 1),
gain AS (SELECT bin, (sum(a) OVER () - coalesce(sum(a) OVER w, 0)) * sum(r) OVER () + coalesce(sum(r) OVER w, 0) * sum(a) OVER () AS gain,
  sum(a) OVER () AS ta, sum(r) OVER () AS tr FROM bins WINDOW w AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
th AS (SELECT coalesce((SELECT bin FROM gain WHERE ta > 0 AND tr > 0 ORDER BY gain DESC, bin LIMIT 1), 0) AS th)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN floor(score / 10000.0) >= th THEN 'allow' ELSE 'block' END) AS verdict, score / 1e6 AS score
FROM sc, th"""
    )
    return "WITH" + ",".join(parts[:-1]) + "," + parts[-1]


SQL["op1_url_filter"] = _url_sql()


SQL["op7_suffix_dedup"] = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s
  FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS p FROM d WHERE length(h) >= 200)
), again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM w) WHERE n > 1
), island AS (
  SELECT doc_id, p, sum(CASE WHEN p > last + 100 OR last IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS i
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS last FROM again)
), span AS (
  SELECT doc_id, i, min(p) AS a, max(p) + 100 AS b FROM island GROUP BY 1, 2
), gap AS (
  SELECT span.doc_id, a, coalesce(lag(b) OVER (PARTITION BY span.doc_id ORDER BY a), 0) AS start FROM span
), rest AS (
  SELECT gap.doc_id, string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) AS h
  FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY 1
), total AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail FROM span GROUP BY 1
)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(CASE WHEN tail IS NULL THEN d.h ELSE rest.h || substr(d.h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN total ON total.doc_id = d.doc_id LEFT JOIN rest ON rest.doc_id = d.doc_id
"""


def _license_sql() -> str:
    """The scan's windows and exact containments; retrieval by bands loses none of them."""
    texts = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in license_scan.TEMPLATES.items())
    split = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH t AS (SELECT name, {split.format(_LOWERED)} AS w FROM (VALUES {texts}) v(name, text)
), ts AS (SELECT DISTINCT name, array_to_string(w[s:s+4], ' ') AS g FROM (SELECT name, w, unnest(generate_series(1, len(w) - 4)) AS s FROM t)
), size AS (SELECT name, count(*) AS n, (2 ** ceil(log2(count(*))))::BIGINT AS step FROM ts GROUP BY 1
), d AS (SELECT doc_id, {split.format(_LOWERED)} AS w FROM documents
), ds AS (SELECT doc_id, s, array_to_string(w[s+1:s+5], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 5)) AS s FROM d WHERE len(w) >= 5)
), hit AS (SELECT doc_id, ts.name, n, step, s, ds.g FROM ds JOIN ts ON ts.g = ds.g JOIN size ON size.name = ts.name
), win AS (SELECT doc_id, name, n, step, k, g FROM (SELECT *, unnest([s // step, s // step - 1, s // step - 2]) AS k FROM hit) WHERE k >= 0
), share AS (SELECT doc_id, name, k * step AS start, count(DISTINCT g)::DOUBLE / n AS share FROM win GROUP BY doc_id, name, n, step, k
), best AS (SELECT doc_id, name, max(share) AS share, arg_max(start, (share, -start)) AS start FROM share WHERE share >= 0.8 GROUP BY 1, 2
), found AS (SELECT doc_id, count(*) AS n_matches, string_agg(name, ',' ORDER BY name) AS licenses, round(max(share), 6) AS best, min(start) AS first_word FROM best GROUP BY 1)
SELECT d.doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, best, first_word::BIGINT AS first_word
FROM d LEFT JOIN found ON found.doc_id = d.doc_id
"""


SQL["op3_license_scan"] = _license_sql()

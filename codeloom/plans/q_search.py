"""P4, P5, P7–P10, V1, L3, L4 over the stored analysis table of the corpus."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.text import text_representation
from ..operators import alerts as A
from ..operators import search as S
from ..operators import substring_index as SI
from ..operators import vectors as V
from ..session import materialize, scratch_path
from ..sources.alerts_src import DUCK_ALERTS_CTE, alerts
from ..sources.corpus import duck_code_cte
from ..sources.tables import read_table
from .q_extract import AVG, NFUN, NIMP, analysis_table
from .registry import register

WALL = f"WITH {duck_code_cte()}, src AS (SELECT *, CAST(id AS VARCHAR) AS sid, {AVG} AS avg_c FROM code) "
TL = "CAST(CASE id % 3 WHEN 0 THEN 14 + 2 * k WHEN 1 THEN 17 + k ELSE 15 + k END AS INTEGER)"


def _flat(df):
    return df.select("file_path", "language", "n_functions", "n_imports", F.col("metrics.total_lines").alias("total_lines"),
                     F.round("metrics.average_complexity", 6).alias("average_complexity"))


@register("get_result", WALL + f"""SELECT file_path, language, {NFUN} AS n_functions, {NIMP} AS n_imports,
  {TL} AS total_lines, round(avg_c, 6) AS average_complexity FROM src WHERE file_path = '/repo/b1/f_1.go'""")
def get_result(spark, sf_dir):
    """Point lookup by file path."""
    return _flat(S.get_result(analysis_table(spark, sf_dir), "/repo/b1/f_1.go"))


@register("analysis_result", WALL + f"""SELECT file_path, language, {NFUN} AS n_functions, {NIMP} AS n_imports,
  {TL} AS total_lines, round(avg_c, 6) AS average_complexity FROM src""")
def analysis_result(spark, sf_dir):
    """P10: the response projection of every record."""
    return _flat(analysis_table(spark, sf_dir))


@register("search_results_lang", WALL + """SELECT file_path, language, created_at FROM src
  WHERE language = 'go' ORDER BY created_at DESC, file_path LIMIT 20""")
def search_results_lang(spark, sf_dir):
    """P5: language filter, newest first, limit 20."""
    r = S.search_results(analysis_table(spark, sf_dir), language="go", limit=20)
    return r.select("file_path", "language", "created_at")


@register("search_results_ilike", WALL + """SELECT file_path, created_at FROM src WHERE file_path ILIKE '%B1_/%'""")
def search_results_ilike(spark, sf_dir):
    """P5: ILIKE substring; ``_`` stays a wildcard as in the reference."""
    r = S.search_results(analysis_table(spark, sf_dir), file_path_pattern="B1_/")
    return r.select("file_path", "created_at")


@register("search_results_range", WALL + """SELECT file_path, round(avg_c, 6) AS average_complexity FROM src
  WHERE avg_c >= 2.0 AND avg_c <= 3.0""")
def search_results_range(spark, sf_dir):
    """P5: complexity band on the nested metrics field (pushed to the scan)."""
    r = S.search_results(analysis_table(spark, sf_dir), min_complexity=2.0, max_complexity=3.0)
    return r.select("file_path", F.round("metrics.average_complexity", 6).alias("average_complexity"))


@register("search_results_all", WALL + """SELECT file_path, created_at FROM src WHERE language = 'python'
  AND file_path ILIKE '%b1%' AND avg_c >= 2.0 AND avg_c <= 3.0 ORDER BY created_at DESC, file_path LIMIT 50""")
def search_results_all(spark, sf_dir):
    """P5: all filters together with a limit."""
    r = S.search_results(analysis_table(spark, sf_dir), language="python", file_path_pattern="b1",
                         min_complexity=2.0, max_complexity=3.0, limit=50)
    return r.select("file_path", "created_at")


@register("search_part_ilike", "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def search_part_ilike(spark, sf_dir):
    """P5's ILIKE on the driver's part names."""
    return read_table(spark, sf_dir, "part").where(F.col("p_name").ilike("%RED%")).select("p_partkey", "p_name")


@register("complexity_range", WALL + """SELECT file_path, round(avg_c, 6) AS complexity_score FROM src
  WHERE avg_c BETWEEN 2.0 AND 3.0 ORDER BY avg_c DESC, file_path LIMIT 5""")
def complexity_range(spark, sf_dir):
    """Inclusive band, highest first, top 5."""
    r = S.complexity_range(analysis_table(spark, sf_dir), 2.0, 3.0, 5)
    return r.select("file_path", F.round("complexity_score", 6).alias("complexity_score"))


@register("function_name_search", WALL + """SELECT file_path, name AS matched_function, line AS start_line FROM (
  SELECT file_path, 'run_' || sid AS name, 4 AS line FROM src WHERE id % 3 = 0
  UNION ALL SELECT file_path, 'run' || sid, CASE id % 3 WHEN 1 THEN 5 ELSE 9 END FROM src WHERE id % 3 <> 0) t
  WHERE strpos(lower(name), 'run_1') > 0 ORDER BY file_path, line LIMIT 5""")
def function_name_search(spark, sf_dir):
    """Substring (not pattern) match on function names, first 5."""
    r = S.function_name_search(analysis_table(spark, sf_dir), "RUN_1", 5)
    return r.select("file_path", F.col("matched_function.name").alias("matched_function"),
                    F.col("matched_function.position.start_line").alias("start_line"))


NAMES_SQL = """SELECT file_path, name AS matched_function, line AS start_line FROM (
  SELECT file_path, 'run_' || sid AS name, 4 AS line FROM src WHERE id % 3 = 0
  UNION ALL SELECT file_path, 'run' || sid, CASE id % 3 WHEN 1 THEN 5 ELSE 9 END FROM src WHERE id % 3 <> 0) t
  WHERE strpos(lower(name), 'n_11') > 0 ORDER BY file_path, line LIMIT 5"""


@register("function_name_indexed", WALL + NAMES_SQL)
def function_name_indexed(spark, sf_dir):
    """P9 through trigram posting lists of the stored names, verified exactly."""
    a = analysis_table(spark, sf_dir)
    path = scratch_path(spark, "name_grams")
    SI.build(a.select("file_path", F.explode("function_names").alias("text")), path)
    r = SI.function_name_search(a, path, "N_11", 5)
    return r.select("file_path", F.col("matched_function.name").alias("matched_function"),
                    F.col("matched_function.position.start_line").alias("start_line"))


DIP = ("list_sum(list_transform(range(1, len(e.embedding) + 1), "
       "lambda i: CAST(e.embedding[i] AS DOUBLE) * CAST(q.qe[i] AS DOUBLE)))")


@register("topk_lang_post", f"""WITH q AS (SELECT embedding AS qe FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, label, {DIP} AS sc FROM embeddings e, q),
t AS (SELECT vec_id, label, sc, row_number() OVER (ORDER BY sc DESC, vec_id) AS rank FROM s ORDER BY sc DESC, vec_id
      LIMIT 5)
SELECT CAST(rank AS INTEGER) AS rank, vec_id AS id, label, round(sc, 6) AS similarity_score FROM t WHERE label = 2""")
def topk_lang_post(spark, sf_dir):
    """P7 post mode (faithful): rank first, then filter — may return fewer than k."""
    emb = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = emb.orderBy("id").select("embedding").first()[0]
    top = V.topk_single(emb, q, 5)
    return S.language_filter(top, 2, "label").select(
        "rank", "id", "label", F.round("similarity_score", 6).alias("similarity_score"))


@register("topk_lang_pre", f"""WITH q AS (SELECT embedding AS qe FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, label, {DIP} AS sc FROM embeddings e, q WHERE label = 2)
SELECT CAST(row_number() OVER (ORDER BY sc DESC, vec_id) AS INTEGER) AS rank, vec_id AS id, label,
  round(sc, 6) AS similarity_score FROM s ORDER BY sc DESC, vec_id LIMIT 5""")
def topk_lang_pre(spark, sf_dir):
    """P7 pre mode: filter (pushed into the scan), then rank — always k rows when possible."""
    emb = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    q = emb.orderBy("id").select("embedding").first()[0]
    top = V.topk_single(S.language_filter(emb, 2, "label"), q, 5)
    return top.select("rank", "id", "label", F.round("similarity_score", 6).alias("similarity_score"))


def code_texts(spark, sf_dir, body_chars=None):
    a = analysis_table(spark, sf_dir)
    return a.select("file_path", "language", text_representation(
        F.col("file_path"), F.col("language"), F.col("functions"), F.col("classes"), F.col("imports"),
        F.col("metrics"), body_chars).alias("text_for_embedding"))


TEXT_200_SQL = f"""WITH {duck_code_cte()}, src AS (SELECT *, CAST(id AS VARCHAR) AS sid FROM code)
SELECT file_path, CASE id % 3
  WHEN 0 THEN concat('File: ', file_path, ' Language: python',
    ' Function: run_', sid, ' Parameters: a Body: ',
      left(substr(content, strpos(content, 's = "if'), 43 + 28 * k), 200), '...',
    ' Function: m_', sid, ' Parameters: self, v Body: ',
      left(substr(content, strpos(content, 'while v:'), 43), 200), '...',
    ' Class: K', sid, ' Methods: m_', sid, ' Body: ',
      left(substr(content, strpos(content, '    def m_') + 4, 68 + length(sid)), 200), '...',
    ' Imports: os typing List Metrics: Lines=', CAST(14 + 2 * k AS VARCHAR),
    ', Complexity=', printf('%.2f', (k + 6) / 3.0))
  WHEN 1 THEN concat('File: ', file_path, ' Language: go',
    ' Function: run', sid, ' Parameters: a: int, m: interface{{}} Body: ',
      left(substr(content, strpos(content, 'int {{') + 4, 32 + 18 * k), 200), '...',
    ' Imports: import "fmt" Metrics: Lines=', CAST(17 + k AS VARCHAR),
    ', Complexity=', printf('%.2f', (k + 3) / 2.0))
  ELSE concat('File: ', file_path, ' Language: java',
    ' Function: run', sid, ' Parameters: a: Object, b: List<String> Body: ',
      left(substr(content, strpos(content, 'b) {{') + 3, 61 + 28 * k), 200), '...',
    ' Class: C', sid, ' Methods: run', sid, ' Body: ',
      left(substr(content, strpos(content, sid || ' {{') + length(sid) + 1, 125 + length(sid) + 28 * k), 200), '...',
    ' Imports: import java.util.List; import java.lang.Math.abs; Metrics: Lines=', CAST(15 + k AS VARCHAR),
    ', Complexity=', printf('%.2f', CAST(k + 2 AS DOUBLE)))
  END AS text_for_embedding FROM src"""
# the same with whole bodies: left(x, 200), '...' becomes x
TEXT_SQL = re.sub(r"left\((substr\(.*), 200\), '\.\.\.'", r"\1", TEXT_200_SQL)


@register("text_repr", TEXT_SQL)
def text_repr(spark, sf_dir):
    """V1: the embedding text of every analysed file, bodies whole."""
    return code_texts(spark, sf_dir).select("file_path", "text_for_embedding")


@register("text_repr_200", TEXT_200_SQL)
def text_repr_200(spark, sf_dir):
    """V1 with the first 200 characters of each body."""
    return code_texts(spark, sf_dir, 200).select("file_path", "text_for_embedding")


def code_vectors(spark, sf_dir, dim=64):
    t = code_texts(spark, sf_dir)
    emb = V.hash_embed(t, "file_path", "text_for_embedding", dim)
    # One row for each file on either side: never a broadcast, however small the table on disk.
    return emb.hint("merge").join(t.select("file_path", "language").hint("merge"), "file_path")


def related_code(spark, sf_dir, k=5, dim=64):
    """L3: top-k related files per alert.  Alert texts repeat a lot, so each
    distinct text is searched once and the result joined back by text; it is a
    written table, so that adaptive execution can split a text most alerts share."""
    al = A.alert_text(alerts(spark, sf_dir))
    qv = V.hash_embed(al.select("query_text").distinct(), "query_text", "query_text", dim)
    vecs = materialize(code_vectors(spark, sf_dir, dim), "code_vectors")
    top = V.topk_batch(spark, materialize(qv, "alert_vectors"), vecs, k, qid_col="query_text", id_col="file_path")
    per_text = top.withColumnsRenamed({"qid": "query_text", "id": "file_path"}).join(vecs.select("file_path", "language"), "file_path")
    return al, per_text


RELATED_SQL = f"""{TEXT_SQL.replace("SELECT file_path, CASE id % 3", "codetext AS (SELECT file_path, language, CASE id % 3", 1).replace(" AS sid FROM code)", " AS sid FROM code),", 1)}),
{DUCK_ALERTS_CTE},
al AS (SELECT *, concat_ws(' ', alert_type, alert_message) AS query_text FROM alerts),
t AS (SELECT 'c' AS side, file_path AS key, unnest(regexp_extract_all(lower(text_for_embedding), '\\w+')) AS tok FROM codetext
  UNION ALL SELECT 'q', query_text, unnest(regexp_extract_all(lower(query_text), '\\w+')) FROM (SELECT DISTINCT query_text FROM al)),
n AS (SELECT side, key, CAST(('0x' || substr(md5(tok), 1, 8))::BIGINT % 64 AS INTEGER) AS bucket, count(*) AS n FROM t GROUP BY 1, 2, 3),
w AS (SELECT side, key, bucket, CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY side, key)) AS FLOAT) AS DOUBLE) AS w FROM n),
s AS (SELECT q.key AS query_text, c.key AS file_path, round(sum(q.w * c.w), 12) AS sc FROM w q JOIN w c USING (bucket)
  WHERE q.side = 'q' AND c.side = 'c' GROUP BY 1, 2),
every AS (SELECT q.query_text, c.file_path, c.language, coalesce(s.sc, 0.0) AS sc FROM (SELECT DISTINCT query_text FROM al) q, codetext c
  LEFT JOIN s ON s.query_text = q.query_text AND s.file_path = c.file_path),
r AS (SELECT *, row_number() OVER (PARTITION BY query_text ORDER BY sc DESC, file_path) AS rank FROM every),
top AS (SELECT * FROM r WHERE rank <= 5) """


@register("alert_related", RELATED_SQL + """SELECT alert_id, CAST(rank AS INTEGER) AS rank, top.file_path, round(sc, 6) AS similarity_score
FROM al JOIN top USING (query_text)""")
def alert_related(spark, sf_dir):
    """L3: (alert, rank, related file) rows — 5 per alert when ≥ 5 files exist."""
    al, per_text = related_code(spark, sf_dir)
    return al.select("alert_id", "query_text").join(per_text, "query_text").select(
        "alert_id", F.col("rank").cast("int").alias("rank"), "file_path", F.round("similarity_score", 6).alias("similarity_score"))


@register("alert_result", RELATED_SQL + f"""SELECT alert_id, alert_type, alert_message, severity,
  (SELECT string_agg(top.file_path || ' ' || top.language, ',' ORDER BY rank) FROM top WHERE top.query_text = al.query_text) AS related_code,
  '{" | ".join(A.SUGGESTED_FIXES)}' AS suggested_fixes FROM al""")
def alert_result(spark, sf_dir):
    """L4: one row per alert with its related code, best first, and suggestions."""
    al, per_text = related_code(spark, sf_dir)
    nested = materialize(per_text.groupBy("query_text").agg(F.array_sort(F.collect_list(
        F.struct("rank", "file_path", "language", "similarity_score"))).alias("related_code")), "related")
    out = A.with_suggestions(al.join(nested, "query_text", "left"))
    return out.select("alert_id", "alert_type", "alert_message", "severity",
                      F.array_join(F.transform("related_code", lambda x: F.concat_ws(" ", x["file_path"], x["language"])), ",").alias("related_code"),
                      F.array_join("suggested_fixes", " | ").alias("suggested_fixes"))


SEARCH_TEXT = "run list of string"


@register("code_search_text", RELATED_SQL.replace("SELECT DISTINCT query_text FROM al", f"SELECT '{SEARCH_TEXT}' AS query_text") + """SELECT
  CAST(rank AS INTEGER) AS rank, file_path, language, round(sc, 6) AS similarity_score FROM top""")
def code_search_text(spark, sf_dir):
    """V3 + V5: a text query embedded and searched over the code vectors."""
    q = V.embed_text(spark, SEARCH_TEXT)
    top = V.topk_single(code_vectors(spark, sf_dir), q, 5, id_col="file_path")
    return top.select("rank", "file_path", "language", F.round("similarity_score", 6).alias("similarity_score"))


@register("analysis_response", f"""WITH {duck_code_cte()}, src AS (SELECT *, CAST(id AS VARCHAR) AS sid, {AVG} AS avg_c FROM code)
SELECT file_path, language,
  CASE id % 3 WHEN 0 THEN 'run_' || sid || '(a):' || (k + 2) || ';m_' || sid || '(self, v):2'
    WHEN 1 THEN 'run' || sid || '(a: int, m: interface{{}}):' || (k + 2) ELSE 'run' || sid || '(a: Object, b: List<String>):' || (k + 2) END AS functions,
  CASE id % 3 WHEN 0 THEN 'K' || sid || ' m_' || sid WHEN 1 THEN '' ELSE 'C' || sid || ' run' || sid END AS classes,
  CASE id % 3 WHEN 1 THEN 'T' || sid || ' Value int,Name *string' ELSE '' END AS structs,
  CASE id % 3 WHEN 0 THEN 'os typing List' WHEN 1 THEN 'import "fmt"' ELSE 'import java.util.List; import java.lang.Math.abs;' END AS imports,
  {TL} AS total_lines, round(avg_c, 6) AS average_complexity, false AS has_errors,
  CASE id % 3 WHEN 2 THEN 'tree-sitter' END AS parser_used, CAST(NULL AS VARCHAR) AS error FROM src""")
def analysis_response(spark, sf_dir):
    """P10: the whole response record, its lists rendered as text."""
    r = S.response(analysis_table(spark, sf_dir))
    text = lambda c, f, sep=";": F.array_join(F.transform(c, f), sep).alias(c)
    return r.select(
        "file_path", "language",
        text("functions", lambda f: F.concat(f["name"], F.lit("("), F.array_join(f["parameters"], ", "), F.lit("):"), f["complexity"].cast("string"))),
        text("classes", lambda c: F.concat_ws(" ", c["name"], F.array_join(F.transform(c["methods"], lambda m: m["name"]), ","))),
        text("structs", lambda s: F.concat_ws(" ", s["name"], F.array_join(F.transform(s["fields"], lambda x: F.concat_ws(" ", x["name"], x["type"])), ","))),
        text("imports", lambda i: i["text"], " "), "metrics.total_lines", F.round("metrics.average_complexity", 6).alias("average_complexity"),
        "has_errors", "parser_used", "error")


def _dispatch_sql():
    from .registry import oracles
    part = "SELECT '{0}' AS search_type, file_path FROM ({1}) t"
    o = oracles()
    return " UNION ALL ".join(part.format(k, o[q]) for k, q in (("function_name", "function_name_search"), ("complexity", "complexity_range"), ("semantic", "code_search_text")))


@register("search_dispatch", _dispatch_sql())
def search_dispatch(spark, sf_dir):
    """The three search types through one dispatch."""
    a, v = analysis_table(spark, sf_dir), code_vectors(spark, sf_dir)
    ask = lambda kind, query, **k: S.search_code(a, v, query, kind, 5, embed=lambda t: V.embed_text(spark, t), **k).select(
        F.lit(kind).alias("search_type"), "file_path")
    return (ask("function_name", "RUN_1").unionByName(ask("complexity", "", min_complexity=2.0, max_complexity=3.0))
            .unionByName(ask("semantic", SEARCH_TEXT)))


SPANS = """spans AS (
  SELECT file_path, 'run_' || CAST(id AS VARCHAR) AS name, 4 AS s, 6 + 2 * k AS e FROM code WHERE id % 3 = 0
  UNION ALL SELECT file_path, 'm_' || CAST(id AS VARCHAR), 9 + 2 * k, 12 + 2 * k FROM code WHERE id % 3 = 0
  UNION ALL SELECT file_path, 'run' || CAST(id AS VARCHAR), 5, 8 + k FROM code WHERE id % 3 = 1
  UNION ALL SELECT file_path, 'run' || CAST(id AS VARCHAR), 9, 12 + k FROM code WHERE id % 3 = 2)"""


@register("alert_enclosing", f"""WITH {duck_code_cte()}, {DUCK_ALERTS_CTE}, {SPANS}
SELECT a.alert_id, a.file_path, a.line_number,
  (SELECT arg_max(name, s) FROM spans WHERE spans.file_path = a.file_path
     AND a.line_number BETWEEN spans.s AND spans.e) AS enclosing_function FROM alerts a""")
def alert_enclosing(spark, sf_dir):
    """Each alert's own file and line → the innermost enclosing function."""
    a = alerts(spark, sf_dir)
    return A.enclosing_function(a, analysis_table(spark, sf_dir)).select(
        "alert_id", "file_path", "line_number", "enclosing_function")

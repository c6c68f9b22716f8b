"""P1–P3, P6, S5, S11 over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import languages as L
from ..functions.paths import duck_remap_sql, remap_path
from ..sources.corpus import PATH_EXPR, code_files, duck_code_cte
from ..sources.decode import decode_policy, is_valid_utf8
from ..sources.tables import read_table
from .registry import register

ALIAS_EXPR = ("CASE p_partkey % 6 WHEN 0 THEN upper(CASE p_partkey % 3 WHEN 0 THEN 'py' WHEN 1 THEN 'go' "
              "ELSE 'java' END) WHEN 1 THEN 'Python' WHEN 2 THEN 'golang' WHEN 3 THEN 'JaVa' "
              "WHEN 4 THEN split_part(p_name, ' ', 1) ELSE 'GO' END")
ODD_PATH_EXPR = ("concat('/x/', replace(p_name, ' ', '_'), CASE p_partkey % 4 WHEN 0 THEN '.PY' "
                 "WHEN 1 THEN '.golang' WHEN 2 THEN '' ELSE '.tar.java' END)")
HIDDEN_PATH_EXPR = "concat('/x/', CAST(p_partkey AS STRING), '/.', split_part(p_name, ' ', 2))"
DIM_CTE = f"dim AS ({L.LANGUAGE_DIM_SQL})"


@register("lang_by_alias", f"""WITH {DIM_CTE}, a AS (SELECT p_partkey AS id, {ALIAS_EXPR} AS alias_in FROM part)
SELECT id, alias_in, dim.language, dim.parser, dim.language IS NOT NULL AS supported
FROM a LEFT JOIN dim ON lower(alias_in) = dim.alias""")
def lang_by_alias(spark, sf_dir):
    """P1 + P3: resolve a name/alias (case-insensitive), parser info, membership."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    a = part.select(F.col("p_partkey").alias("id"), F.expr(ALIAS_EXPR).alias("alias_in"))
    dim = L.language_dim(spark)
    d = dim.select(F.col("alias").alias("__a"), "language", "parser")
    return (a.join(F.broadcast(d), F.lower("alias_in") == F.col("__a"), "left")
             .select("id", "alias_in", "language", "parser", F.col("language").isNotNull().alias("supported")))


@register("lang_by_extension", f"""WITH {DIM_CTE}, p AS (
  SELECT {PATH_EXPR} AS path FROM part UNION ALL SELECT {ODD_PATH_EXPR} FROM part
  UNION ALL SELECT {HIDDEN_PATH_EXPR} FROM part)
SELECT path, lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) AS suffix, dim.language
FROM p LEFT JOIN dim ON lower(regexp_extract(path, '[^/]\\.([^./]+)$', 1)) = dim.alias""")
def lang_by_extension(spark, sf_dir):
    """Language from the last file suffix (``.bashrc`` has none)."""
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_name")
    p = (part.select(F.expr(PATH_EXPR).alias("path"))
             .unionByName(part.select(F.expr(ODD_PATH_EXPR).alias("path")))
             .unionByName(part.select(F.expr(HIDDEN_PATH_EXPR).alias("path"))))
    out = L.resolve_by_extension(p, "path", L.language_dim(spark))
    return out.select("path", L.file_suffix(F.col("path")).alias("suffix"), "language")


PATH_MAP = [("/repo/b1", "/app/one"), ("/repo/b12", "/app/twelve"), ("/repo", "/srv/code")]


@register("path_remap", f"""WITH {duck_code_cte()}, p AS (
  SELECT file_path AS path FROM code
  UNION ALL SELECT concat('/repo/b', CAST(id % 25 AS VARCHAR)) FROM code
  UNION ALL SELECT concat('/repo/b1', file_path) FROM code
  UNION ALL SELECT concat('/repos', file_path) FROM code)
SELECT path, {duck_remap_sql('path', PATH_MAP)} AS container_path FROM p""")
def path_remap(spark, sf_dir):
    """Equal paths, children, look-alike siblings and repeated prefixes."""
    code = code_files(spark, sf_dir).select("file_path", "id")
    p = (code.select(F.col("file_path").alias("path"))
             .unionByName(code.select(F.concat(F.lit("/repo/b"), (F.col("id") % 25).cast("string")).alias("path")))
             .unionByName(code.select(F.concat(F.lit("/repo/b1"), "file_path").alias("path")))
             .unionByName(code.select(F.concat(F.lit("/repos"), "file_path").alias("path"))))
    return p.select("path", remap_path(F.col("path"), PATH_MAP).alias("container_path"))


@register("decode_policy", """
SELECT doc_id, variant, language, valid_utf8, n_chars FROM (
  SELECT doc_id, 'utf8' AS variant, l.language, true AS valid_utf8, CAST(length(text) AS INTEGER) AS n_chars
  FROM documents, (VALUES ('python'), ('go'), ('java')) l(language)
  UNION ALL
  SELECT doc_id, 'bad', l.language, false,
    CASE WHEN l.language = 'java' THEN CAST(strlen(text) + 1 AS INTEGER) END
  FROM documents, (VALUES ('python'), ('go'), ('java')) l(language)) t""")
def decode_policy_q(spark, sf_dir):
    """Each document as valid UTF-8 bytes and with a stray 0xFF byte, under
    each language's policy (NULL = rejected)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    raw = docs.select("doc_id", F.encode("text", "UTF-8").alias("b"))
    variants = (raw.select("doc_id", F.lit("utf8").alias("variant"), F.col("b").alias("raw"))
                   .unionByName(raw.select("doc_id", F.lit("bad").alias("variant"),
                                           F.concat("b", F.unhex(F.lit("FF"))).alias("raw"))))
    langs = F.explode(F.array(*[F.lit(x) for x in ("python", "go", "java")])).alias("language")
    v = variants.select("doc_id", "variant", "raw", langs)
    return v.select("doc_id", "variant", "language", is_valid_utf8(F.col("raw")).alias("valid_utf8"),
                    F.length(decode_policy(F.col("language"), F.col("raw"))).alias("n_chars"))


@register("json_roundtrip", """
SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
  CAST(to_json({'k': CAST(json_extract(props, '$.k') AS INTEGER)}) AS VARCHAR) AS props_json FROM events""")
def json_roundtrip(spark, sf_dir):
    """Decode the JSON payload with an explicit schema, encode it back."""
    ev = read_table(spark, sf_dir, "events").select("event_id", "props")
    parsed = ev.select("event_id", F.from_json("props", "k INT").alias("j"))
    return parsed.select("event_id", F.col("j.k").alias("k"), F.to_json("j").alias("props_json"))


@register("scan_repo", f"""WITH {duck_code_cte()}
SELECT file_path, language,
  CAST(CASE id % 3 WHEN 0 THEN 14 + 2 * k WHEN 1 THEN 17 + k ELSE 15 + k END AS INTEGER) AS total_lines,
  CAST(length(content) AS BIGINT) AS n_bytes FROM code""")
def scan_repo_q(spark, sf_dir):
    """S1–S5 end to end: the corpus is written as a directory tree (in the shared
    checkpoint folder), scanned back with the repository source, decoded and
    measured; paths are reported relative to the tree root."""
    from ..functions.lines import line_metric_cols
    from ..session import scratch_path
    from ..sources.repo_scan import local_path, scan_repo, write_tree
    root = local_path(scratch_path(spark, "repo_tree"))
    write_tree(code_files(spark, sf_dir), root)
    files, _rejects = scan_repo(spark, root)
    m = line_metric_cols(F.col("content"), F.col("language"))
    return files.select(F.expr(f"substring(file_path, {len(root) + 1})").alias("file_path"), "language",
                        m["total_lines"].alias("total_lines"), "n_bytes")


@register("scan_rejects", f"""WITH {duck_code_cte()}
SELECT CASE id % 10 WHEN 0 THEN file_path || '.rs' ELSE '/bad' || file_path END AS file_path,
  CASE WHEN id % 10 = 0 THEN NULL ELSE language END AS language,
  CASE id % 10 WHEN 0 THEN 'unknown language' ELSE 'invalid utf-8' END AS reason
FROM code WHERE id % 10 = 0 OR (id % 10 = 1 AND language <> 'java')""")
def scan_rejects(spark, sf_dir):
    """S3 + S5: the corpus tree with a tenth of the files also under a suffix of
    no known language and a tenth also with a stray byte: what is not accepted,
    and why.  (Java files with such a byte are Latin-1, hence accepted.)"""
    from ..session import scratch_path
    from ..sources.repo_scan import DEFAULT_PATTERNS, local_path, scan_repo, write_tree
    root = local_path(scratch_path(spark, "repo_tree"))
    code = code_files(spark, sf_dir)
    bad = code.where("id % 10 = 1").select(F.concat(F.lit("/bad"), "file_path").alias("file_path"), F.concat("content", F.lit("\x00BAD")).alias("content"))
    odd = code.where("id % 10 = 0").select(F.concat("file_path", F.lit(".rs")).alias("file_path"), "content")
    write_tree(code.select("file_path", "content").unionByName(bad).unionByName(odd), root, stray=("\x00BAD", b"\xff"))
    _files, rejects = scan_repo(spark, root, DEFAULT_PATTERNS + ",*.rs")
    return rejects.select(F.expr(f"substring(file_path, {len(root) + 1})").alias("file_path"), "language", "reason")


@register("languages", f"""WITH {DIM_CTE}, {duck_code_cte()}
SELECT alias, dim.language, parser, (SELECT count(*) FROM code WHERE code.language = dim.language) AS n_files FROM dim""")
def languages(spark, sf_dir):
    """Every supported name with its parser and the corpus files it covers."""
    n = code_files(spark, sf_dir).groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))
    return (L.supported_languages(L.language_dim(spark)).join(n, "language", "left")
            .select("alias", "language", "parser", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files")))

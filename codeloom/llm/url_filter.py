"""Operator 2: URL filter by a character language-model ratio (DataFrame operations only).

Address rules judge first.  The addresses that they allow and block train two
variable-order Markov models of the characters of ``host + path`` (ASCII
lower-cased, padded at both ends): Witten-Bell smoothing mixes
each context of up to ``order`` characters with its shorter ones, down to a
uniform distribution.  Every other address gets the verdict of its
log-likelihood difference over its length against a threshold calibrated on the
rule-judged ones: the point as many standard deviations from either class mean.

Only distinct addresses are cut into n-grams; counts are grouped sums with
map-side combination.  The n-gram table is bounded by the alphabet, is counted,
and is broadcast only when small.

Defined results: a null url or one without ``://`` has empty host and path, fits
no rule, and is judged as the empty address; all rows stay (repeated ones get
equal verdicts); columns named like a result are replaced; without addresses of
either class there is no model, and what no rule fits is allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import ascii_lower, join_counted, materialize

ALLOW, BLOCK = "allow", "block"
#: (host and path, verdict)
RULES = (("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK), ("net/fr/", BLOCK))
START, END = "\x02", "\x03"


def host_and_path(url):
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def fitting_rule(host, path, rules=RULES):
    """The longest rule that fits, and its verdict (null: none fits)."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: -len(r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def ngram_ratios(address: DataFrame, order: int) -> DataFrame | None:
    """gram (``order`` characters of context and one more) -> llr, for all grams
    of ``address`` (__s, __allow and __block: rows that rules gave each verdict)."""
    grams = materialize(address.select(F.explode(_grams(F.col("__s"), order)).alias("gram"), "__allow", "__block")
                        .groupBy("gram").agg(F.sum("__allow").alias("a"), F.sum("__block").alias("b")), "url-grams")
    total = grams.agg(F.sum("a"), F.sum("b")).first()
    if not total[0] or not total[1]:
        return None
    level = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k")
    cut = lambda size: F.expr(f"right(gram, {size})")
    of_gram = (grams.select("gram", "a", "b", level).select("k", cut("k + 1").alias("hc"), "a", "b")
               .groupBy("k", "hc").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    # a shorter context is the end of a longer one: its own counts and numbers of followers
    of_context = (of_gram.groupBy("k", F.expr("left(hc, k)").alias("h"))
                  .agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum((F.col("a") > 0).cast("long")).alias("ta"), F.sum((F.col("b") > 0).cast("long")).alias("tb")))
    x = (grams.select("gram", level).select("gram", "k", cut("k + 1").alias("hc")).withColumn("h", F.expr("left(hc, k)"))
         .join(of_gram, ["k", "hc"]).join(of_context, ["k", "h"])
         .groupBy("gram").agg(F.array_sort(F.collect_list(F.struct("k", "a", "na", "ta", "b", "nb", "tb"))).alias("levels")))

    def prob(n, seen, kinds):
        return F.aggregate("levels", F.lit(1 / 256.0), lambda p, v: F.when(v[seen] == 0, p).otherwise((v[n] + v[kinds] * p) / (v[seen] + v[kinds])))

    return materialize(x.select("gram", (F.log(prob("a", "na", "ta")) - F.log(prob("b", "nb", "tb"))).alias("llr")), "url-llr")


def _grams(s, order):
    padded = F.concat(F.lit(START * order), s, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(s) + 1), lambda i: padded.substr(i, F.lit(order + 1)))


def judge(pages: DataFrame, url_col: str = "url", rules=RULES, order: int = 4) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (null where no model)."""
    new = ["host", "path", "rule", "verdict", "score"]
    keep = [c for c in pages.columns if c.lower() not in new]
    kept = [f"c{i}" for i in range(len(keep))]                 # under way, so that no name clashes
    old = [F.col(k).alias(c) for c, k in zip(keep, kept)]
    host, path = host_and_path(pages[f"`{url_col}`"].cast("string"))
    x = pages.select(*[pages[f"`{c}`"].alias(k) for c, k in zip(keep, kept)], host.alias("host"), path.alias("path"))
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    x = x.withColumns({"rule": rule, "__says": says, "__s": F.concat("host", ascii_lower(F.col("path")))})
    address = materialize(x.groupBy("__s").agg(F.sum((F.col("__says") == ALLOW).cast("long")).alias("n_allow"), F.sum((F.col("__says") == BLOCK).cast("long")).alias("n_block"))
                          .select("__s", F.coalesce("n_allow", F.lit(0)).alias("__allow"), F.coalesce("n_block", F.lit(0)).alias("__block")), "url-addresses")
    llr = ngram_ratios(address, order)
    if llr is None:
        return x.select(*old, "host", "path", "rule", F.coalesce("__says", F.lit(ALLOW)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    parts = address.select("__s", F.explode(_grams(F.col("__s"), order)).alias("gram"))
    score = materialize(join_counted(parts, llr, ["gram"], "inner").groupBy("__s").agg(F.avg("llr").alias("score")), "url-scores")
    stats = (address.join(score, "__s").select("score", F.explode(F.array(F.struct(F.lit(1).alias("allow"), F.col("__allow").alias("n")), F.struct(F.lit(0).alias("allow"), F.col("__block").alias("n")))).alias("c"))
             .groupBy("c.allow").agg(F.sum("c.n").alias("n"), F.sum(F.col("c.n") * F.col("score")).alias("s"), F.sum(F.col("c.n") * F.col("score") * F.col("score")).alias("q")))
    cut = threshold({r["allow"]: (r["n"], r["s"], r["q"]) for r in stats.collect()})
    verdict = F.coalesce("__says", F.when(F.col("score") >= cut, ALLOW).otherwise(BLOCK))
    return x.join(score, "__s", "left").select(*old, "host", "path", "rule", verdict.alias("verdict"), "score")


def threshold(stats: dict[int, tuple[float, float, float]]) -> float:
    """Equally many standard deviations from either class mean (a small floor
    stands for a class without spread)."""
    m, d = {}, {}
    for k, (n, s, q) in stats.items():
        m[k] = s / n
        d[k] = max(q / n - m[k] ** 2, 0.0) ** 0.5 + 1e-6
    return (m[1] * d[0] + m[0] * d[1]) / (d[0] + d[1])


def oracle_sql(rules=RULES, order: int = 4) -> str:
    """The same in DuckDB SQL: page_id, host, path, rule, verdict, score."""
    fits, says = [], []
    for text, v in sorted(rules, key=lambda r: -len(r[0])):
        h, slash, p = text.partition("/")
        when = f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash}{p}') THEN"
        fits.append(f"{when} '{text}'")
        says.append(f"{when} '{v}'")
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps, prev = [], "grams"
    for k in range(order + 1):
        pa, pb = ("1 / 256.0", "1 / 256.0") if k == 0 else ("x.pa", "x.pb")
        steps.append(f"""p{k} AS (SELECT x.gram,
  CASE WHEN c.na = 0 THEN {pa} ELSE (g.a + c.ta * {pa}) / (c.na + c.ta) END AS pa,
  CASE WHEN c.nb = 0 THEN {pb} ELSE (g.b + c.tb * {pb}) / (c.nb + c.tb) END AS pb
  FROM {prev} x JOIN lev g ON g.k = {k} AND g.hc = right(x.gram, {k + 1}) JOIN ctx c ON c.k = {k} AND c.h = left(right(x.gram, {k + 1}), {k}))""")
        prev = f"p{k}"
    return f"""
WITH a1 AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
a2 AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS h0 FROM a1),
a3 AS (SELECT page_id, {lower.format('h0')} AS host, regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM a2),
a4 AS (SELECT *, CASE {' '.join(fits)} END AS rule, CASE {' '.join(says)} END AS says,
  host || {lower.format('path')} AS s FROM a3),
addr AS (SELECT s, count(*) FILTER (says = '{ALLOW}') AS al, count(*) FILTER (says = '{BLOCK}') AS bl FROM a4 GROUP BY s),
parts AS (SELECT s, al, bl, substr(repeat(chr(2), {order}) || s || chr(3), i, {order + 1}) AS gram
  FROM (SELECT s, al, bl, unnest(generate_series(1, length(s) + 1)) AS i FROM addr)),
grams AS (SELECT gram, sum(al) AS a, sum(bl) AS b FROM parts GROUP BY gram),
lev AS (SELECT k, right(gram, k + 1) AS hc, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM (SELECT *, unnest(generate_series(0, {order}))::INT AS k FROM grams) GROUP BY ALL),
ctx AS (SELECT k, left(hc, k) AS h, sum(a) AS na, sum(b) AS nb, count(*) FILTER (a > 0) AS ta, count(*) FILTER (b > 0) AS tb FROM lev GROUP BY ALL),
{', '.join(steps)},
score AS (SELECT s, avg(ln(pa) - ln(pb)) AS score FROM parts JOIN p{order} USING (gram) GROUP BY s),
st AS (SELECT sum(al) AS na, sum(al * score) / sum(al) AS ma, sum(al * score * score) / sum(al) AS qa,
  sum(bl) AS nb, sum(bl * score) / sum(bl) AS mb, sum(bl * score * score) / sum(bl) AS qb FROM addr JOIN score USING (s)),
sd AS (SELECT *, sqrt(greatest(qa - ma * ma, 0)) + 1e-6 AS da, sqrt(greatest(qb - mb * mb, 0)) + 1e-6 AS db FROM st)
SELECT page_id, host, path, rule, CASE WHEN says IS NOT NULL THEN says
  WHEN na = 0 OR nb = 0 OR score >= (ma * db + mb * da) / (da + db) THEN '{ALLOW}' ELSE '{BLOCK}' END AS verdict
FROM a4 JOIN score USING (s), sd"""

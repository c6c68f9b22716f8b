"""Operator 7: secret scans with an incremental blob ledger (DataFrame operations only).

Every version of every path is content-addressed (SHA-256 of its text, its
blob).  The ledger holds a row for each blob and rule version scanned so far;
only pairs that it lacks are scanned, each blob once, however many paths and
versions hold it.  Findings are joined back to all paths.

A ledger row codes its matches as gaps: (characters since the last match,
length, whether the match counts), which needs one split and one extraction per
rule; positions are running sums.  A match that fails its rule's check is kept
as a gap, because the next match is searched after it.

Defined results: null text counts as empty and has no finding; null paths and
repeated rows stay, each with its own row of findings; columns named like a
result are replaced; an empty table gives an empty table; ties of start go by
the order of the rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeloom.llm.common import join_counted, materialize


#: Blobs with findings and findings (some 100 bytes each) that may be broadcast.
FINDINGS = 200_000


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """A pattern whose matches count if ``group`` has ``least`` characters."""

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


_KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Kinds of the base contract, then kinds with a published fixed shape.
BASE = (
    Rule("assign", 1, f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    Rule("access", 1, "AKIA[A-Z0-9]+", 0, 18),
    # the same matches as of [0-9a-f]+ with 16 characters: a run is matched whole
    Rule("hex", 1, "[0-9a-f]{16,}", 0, 16),
)
MORE = (
    Rule("private_key", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + MORE


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _gaps(text: Column, found: Column, checked: Column, rule: Rule) -> Column:
    """Matches as (gap, len, ok)."""
    between = F.split(text, rule.pattern, -1)
    return F.transform(F.arrays_zip(F.slice(between, 1, F.size(found)).alias("g"), found.alias("m"), checked.alias("c")),
                       lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), (F.length(x["c"]) >= rule.least).alias("ok")))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules=RULES) -> DataFrame:
    """New ledger rows (blob, rule, version, matches) for the pairs of blob and
    rule version that ``ledger`` lacks."""
    text = F.coalesce(versions[f"`{text_col}`"].cast("string"), F.lit(""))
    blobs = versions.select(blob_of(text).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    names = [f"{r.name}:{r.version}" for r in rules]
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen"))
        blobs = (blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
                 .filter(F.size(F.array_except(F.array(*map(F.lit, names)), "seen")) > 0))
    else:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    empty = F.array().cast("array<string>")
    fresh = {n: ~F.array_contains("seen", n) for n in names}
    x = blobs.withColumns({f"m{k}": F.when(fresh[n], F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(empty) for k, (n, r) in enumerate(zip(names, rules))})
    x = x.withColumns({f"c{k}": F.when(F.size(f"m{k}") > 0, F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group))).otherwise(empty) for k, r in enumerate(rules) if r.group})
    none = F.array().cast("array<struct<gap:int,len:int,ok:boolean>>")
    rows = []
    for k, (n, r) in enumerate(zip(names, rules)):
        gaps = F.when(F.size(f"m{k}") > 0, _gaps(F.col("text"), F.col(f"m{k}"), F.col(f"c{k}" if r.group else f"m{k}"), r)).otherwise(none)
        rows.append(F.struct(fresh[n].alias("fresh"), F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), gaps.alias("matches")))
    return x.select("blob", F.explode(F.array(*rows)).alias("r")).filter("r.fresh").select("blob", "r.rule", "r.version", "r.matches")


def spans(ledger: DataFrame, rules=RULES) -> DataFrame:
    """(blob, spans): findings of these rule versions as structs (start, kind
    number, kind, end), in that order; code points, end exclusive."""
    number = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(f"{r.name}:{r.version}"), F.lit(k))])
    x = ledger.withColumn("n", number[F.concat_ws(":", "rule", "version")]).filter("n is not null and size(matches) > 0")
    x = x.select("blob", "rule", "n", F.posexplode("matches").alias("i", "m"))
    upto = F.sum(F.col("m.gap") + F.col("m.len")).over(W.partitionBy("blob", "n").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    x = x.withColumn("end", upto).filter("m.ok")
    one = F.struct((F.col("end") - F.col("m.len")).alias("start"), "n", F.col("rule").alias("kind"), "end")
    return x.groupBy("blob").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text", rules=RULES) -> tuple[DataFrame, DataFrame]:
    """``versions`` with blob and spans (null: nothing found), and the new
    ledger rows, to be appended to the ledger."""
    new = materialize(scan_unseen(versions, ledger, text_col, rules), "secret-ledger")
    all_rows = new if ledger is None else ledger.select("blob", "rule", "version", "matches").unionByName(new)
    found = materialize(spans(all_rows, rules), "secret-findings")
    keep = [c for c in versions.columns if c.lower() not in ("blob", "spans")]
    out = versions.select(*[versions[f"`{c}`"] for c in keep], blob_of(versions[f"`{text_col}`"]).alias("blob"))
    # few findings go to the texts; else both meet in a shuffle
    return join_counted(out, found, ["blob"], "left", FINDINGS, "spans").select(*[F.col(f"`{c}`") for c in keep], "blob", "spans"), new


def mask(text: Column, found: Column) -> Column:
    """``text`` with every span's characters replaced by asterisks; spans may overlap."""
    # fold from the left: what is finished, and the code point up to which it goes
    def step(acc, s):
        begin = F.greatest(s["start"], acc["at"])
        more = F.concat(acc["out"], F.when(begin > acc["at"], text.substr(acc["at"].cast("int") + 1, (begin - acc["at"]).cast("int"))).otherwise(""),
                        F.repeat(F.lit("*"), F.greatest(s["end"] - begin, F.lit(0)).cast("int")))
        return F.struct(more.alias("out"), F.greatest(s["end"], acc["at"]).alias("at"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    done = F.aggregate(found, start, step, lambda a: F.concat(a["out"], text.substr(a["at"].cast("int") + 1, F.length(text))))
    return F.when(F.size(found) > 0, done).otherwise(text)


def digest(found: DataFrame, rules=RULES, base=BASE) -> DataFrame:
    """Per row: n_<kind> of the base kinds, base_sha256 and spans as text."""
    s = F.coalesce(F.col("spans"), F.array().cast("array<struct<start:bigint,n:int,kind:string,end:bigint>>"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of_kind = lambda k: F.size(F.filter(s, lambda x: x["n"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{r.name}") for k, r in enumerate(rules) if r in base]
    return found.select("doc_id", *counts, F.sha2(text(F.filter(s, lambda x: x["n"] < len(base))), 256).alias("base_sha256"), text(s).alias("spans"))


def oracle_sql(rules=RULES, base=BASE) -> str:
    """The digest in DuckDB SQL."""
    quote = lambda p: "'" + p.replace("'", "''") + "'"
    per_rule = " UNION ALL ".join(
        f"SELECT doc_id, rid, {k} AS n, '{r.name}' AS kind, {r.least} AS least, string_split_regex(t, {quote(r.pattern)}) AS g, "
        f"regexp_extract_all(t, {quote(r.pattern)}, 0) AS m, regexp_extract_all(t, {quote(r.pattern)}, {r.group}) AS c FROM d WHERE regexp_matches(t, {quote(r.pattern)})"
        for k, r in enumerate(rules))
    counts = ", ".join(f"count(s) FILTER (n = {k}) AS n_{r.name}" for k, r in enumerate(rules) if r in base)
    order = "ORDER BY s, n"
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
r AS ({per_rule}),
e AS (SELECT rid, n, kind, least, unnest(range(1, len(m) + 1)) AS i, unnest(list_slice(g, 1, len(m))) AS gap, unnest(m) AS m, unnest(c) AS c FROM r),
p AS (SELECT rid, n, kind, length(c) >= least AS ok, length(m) AS size,
  sum(length(gap) + length(m)) OVER (PARTITION BY rid, n ORDER BY i) AS stop FROM e),
f AS (SELECT rid, n, kind, (stop - size)::BIGINT AS s, stop::BIGINT AS stop FROM p WHERE ok),
j AS (SELECT d.rid, doc_id, n, s, kind || ':' || s || ':' || stop AS x FROM d LEFT JOIN f USING (rid))
SELECT doc_id, {counts}, sha256(coalesce(string_agg(x, ',' {order}) FILTER (n < {len(base)}), '')) AS base_sha256,
  coalesce(string_agg(x, ',' {order}), '') AS spans
FROM j GROUP BY rid, doc_id"""

"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefix, confirmed by digest.

Only DataFrame functions are used. A URL is expanded into the expressions that a rule could have: as many
trailing host labels and leading path characters as some rule has (its shape). Expressions meet the rules in
an equi-join on the first digits of their SHA-256; the full digest then decides. Of the rules that fit, the
longest text wins, then the longer host, then `block`.

Defined results: a null url, or one without "://", has an empty host and path and no rule; a URL that no rule
fits gets the default verdict; equal pages give equal rows; an empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, table

#: (verdict, host, path); a rule's path is what the url's path must start with.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: What no rule fits is allowed, as for any block list.
DEFAULT_VERDICT = "allow"
#: Hex digits of the hash prefix that is joined on.
PREFIX_DIGITS = 8
#: Rules up to this count (some 200 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty where there is no url or no "://"."""
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    """The rules as a table, with their expression's digest and its prefix."""
    quoted = ["(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in r) + ")" for r in rules]
    body = f"VALUES {', '.join(quoted)}" if quoted else "SELECT '' , '', '' WHERE false"
    frame = spark.sql(f"SELECT * FROM ({body}) AS t(verdict, rule_host, rule_path)")
    return prepared(frame)


def prepared(rules: DataFrame) -> DataFrame:
    """Any table of verdict, rule_host and rule_path made ready for the join."""
    host = F.translate("rule_host", _UPPER, _LOWER)
    expression = F.concat(host, F.col("rule_path"))
    return rules.select(
        "verdict",
        expression.alias("rule"),
        F.size(F.split(host, r"\.")).alias("labels"),
        F.length("rule_path").alias("chars"),
        F.length(host).alias("host_chars"),
        F.sha2(expression, 256).alias("rule_digest"),
        F.substring(F.sha2(expression, 256), 1, PREFIX_DIGITS).alias("prefix"),
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    Each page takes its own expressions to the rules and back, under page_id, host and path: a host that many pages
    share is no key. The expressions of a page stay in one task until the best rule is found, so that little is sent.
    """
    host, path = parse_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    # rules that have one expression are one rule; the shapes are few: host labels times lengths of paths
    single = rules.groupBy("rule_digest").agg(F.max(F.struct("host_chars", (F.col("verdict") == "block").alias("blocks"), "rule", "verdict", "prefix")).alias("r"))
    single = single.select("rule_digest", "r.*")
    shapes = [tuple(r) for r in rules.select("labels", "chars").distinct().collect()]
    n_rules = rules.count()
    labels = F.col("labels")
    candidates = [
        F.when(
            (F.size(labels) >= k) & (F.length("path") >= n) & (F.col("host") != ""),
            F.concat(F.array_join(F.slice(labels, -k, k), "."), F.substring("path", 1, n)),
        )
        for k, n in sorted(shapes)
    ]
    # the first expression, always null, stands for the page itself
    expanded = (
        urls.withColumn("labels", F.split("host", r"\."))
        .select("page_id", "host", "path", F.posexplode(F.array(F.lit(None).cast("string"), *candidates)).alias("place", "expression"))
        .filter("place = 0 OR expression IS NOT NULL")
        .withColumn("digest", F.sha2("expression", 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    met = expanded.alias("e").join(small(single, n_rules, BROADCAST_RULES).alias("r"), (F.col("e.prefix") == F.col("r.prefix")) & (F.col("e.digest") == F.col("r.rule_digest")), "left")
    best = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule"), "host_chars", "blocks", "rule", "verdict")))
    judged = met.groupBy("page_id", "host", "path").agg(best.alias("best"), F.count_if(F.col("place") == 0).alias("rows"))
    each = judged.select("page_id", "host", "path", "best", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return each.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), rules_frame(spark))


SQL = """
WITH r(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (
  SELECT row_number() OVER () AS k, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), v AS (SELECT k, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
w AS (SELECT k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM v),
m AS (
  SELECT k, h || p AS rule, verdict, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC, length(h) DESC, verdict DESC) AS rank
  FROM w JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM w LEFT JOIN (SELECT * FROM m WHERE rank = 1) USING (k)
"""

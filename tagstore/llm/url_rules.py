"""URL filters: fixed host and path rules, and association rules mined by FP-growth; DataFrame functions only."""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
BROADCAST_ROWS = 100_000  # combinations of tokens, or postings, up to which a table is broadcast

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def with_parts(pages: DataFrame) -> DataFrame:
    """Add host and path. A null url, or one without `://`, has both empty."""
    url = F.coalesce("url", F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER)).withColumn(
        "path", F.regexp_extract(url, PARTS, 2)
    )


def fixed_rule(rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits host and path; null if none does."""
    out = None
    for verdict, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        hit = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return out


def tokens() -> Column:
    """Sorted distinct tokens of a url: top domain, site, first host label, first path segment, first character of the second, file ending, keys of the query, fragment."""
    rest = F.regexp_extract(F.coalesce("url", F.lit("")), PARTS, 3)
    top = F.regexp_extract("host", r"([^.]+)$", 1)
    site = F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)
    sub = F.regexp_extract("host", r"^([^.]+)\.[^.]+\.[^.]+", 1)
    one = F.regexp_extract("path", r"^/([^/]+)", 1)
    two = F.regexp_extract("path", r"^/[^/]+/([^/])", 1)
    ending = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)
    named = [("top=", top), ("site=", site), ("sub=", sub), ("one=", one), ("two=", two), ("end=", ending), ("key=", F.regexp_extract(rest, r"^\?([^=&#]+)", 1)), ("mark=", F.regexp_extract(rest, r"#(.+)$", 1))]
    made = F.array(*[F.when(c != "", F.concat(F.lit(n), c)) for n, c in named])
    return F.array_sort(F.array_distinct(F.filter(made, lambda x: x.isNotNull())))


def mine(labelled: DataFrame, support=0.05, confidence=0.95, lift=1.2, most_tokens=3) -> DataFrame:
    """Rules (antecedent, confidence, support) that imply `block`, from columns tokens and verdict.

    Spark's FP-growth finds token combinations in at least `support` of the labelled rows; rules
    keep at least `confidence`, a lift of at least `lift` over the share of blocked rows, and at most `most_tokens` tokens. No labelled rows: no rules.
    """
    labelled = labelled.select(F.array_append("tokens", F.concat(F.lit("verdict="), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(labelled)
    rules = model.associationRules
    return rules.filter((F.size("antecedent") <= most_tokens) & (F.col("consequent")[0] == "verdict=block") & (F.col("lift") >= lift)).select("antecedent", "confidence", "support")


def judge(pages: DataFrame, rules=RULES, **how) -> DataFrame:
    """pages with host, path, rule and verdict; every row is kept, and other columns pass through; columns of pages with these names give way.

    The longest fitting fixed rule decides. The rows it decides are the labels for mine(); a row
    that no fixed rule fits is blocked if all tokens of a mined rule are among its own, else
    allowed. Matching runs over distinct token combinations through an inverted index from token
    to rules, so a common host is matched once. Null and broken urls have no tokens and are
    allowed. An empty table gives no rows.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parts = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("page"), "url")
    parts = with_parts(parts).withColumn("_fixed", fixed_rule(rules)).withColumn("_tokens", tokens())
    labelled = parts.filter(F.col("_fixed").isNotNull()).select(F.col("_tokens").alias("tokens"), F.col("_fixed.verdict").alias("verdict"))
    mined = mine(labelled, **how).select("antecedent", F.monotonically_increasing_id().alias("rule_id"))
    postings = mined.select("rule_id", F.size("antecedent").alias("size"), F.explode("antecedent").alias("token"))
    combos = parts.filter(F.col("_fixed").isNull()).groupBy(F.concat_ws("\n", "_tokens").alias("_combo")).agg(F.first("_tokens").alias("t"))
    found = (
        combos.select("_combo", F.explode("t").alias("token"))
        .join(bounded(postings), "token")
        .groupBy("_combo", "rule_id", "size")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") == F.col("size"))
        .select("_combo", F.lit("block").alias("_mined"))
        .distinct()
    )
    out = parts.withColumn("_combo", F.concat_ws("\n", "_tokens")).join(bounded(found), "_combo", "left")
    verdict = F.coalesce(F.col("_fixed.verdict"), F.col("_mined"), F.lit("allow"))
    return out.select("page.*", "host", "path", F.col("_fixed.rule").alias("rule"), verdict.alias("verdict"))


def bounded(df: DataFrame) -> DataFrame:
    """A broadcast hint if df has at most BROADCAST_ROWS rows; beyond that the join shuffles."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def op2(spark, sf_dir):
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql_tokens():
    rx = lambda c, p: f"regexp_extract({c}, '{p}', 1)"
    named = [("top=", rx("host", r"([^.]+)$")), ("site=", rx("host", r"([^.]+\.[^.]+)$")), ("sub=", rx("host", r"^([^.]+)\.[^.]+\.[^.]+")), ("one=", rx("path", r"^/([^/]+)")), ("two=", rx("path", r"^/[^/]+/([^/])")), ("end=", rx("path", r"\.([A-Za-z0-9]{1,5})$")), ("key=", rx("rest", r"^\?([^=&#]+)")), ("mark=", rx("rest", r"#(.+)$"))]
    return "list_distinct(list_filter([" + ", ".join(f"CASE WHEN {c} <> '' THEN '{n}' || {c} END" for n, c in named) + "], lambda x: x IS NOT NULL))"


def _sql_rules():
    return ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


OP2_SQL = rf"""
WITH u AS (SELECT page_id, row_number() OVER () AS rid,
    translate(regexp_extract(coalesce(url, ''), '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '{PARTS}', 2) AS path, regexp_extract(coalesce(url, ''), '{PARTS}', 3) AS rest FROM pages),
rules(verdict, h, p) AS (VALUES {_sql_rules()}),
m AS (SELECT rid, max_by(h || p, length(h || p)) AS rule, max_by(verdict, length(h || p)) AS verdict FROM u JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid),
t AS (SELECT u.*, m.rule, m.verdict, {_sql_tokens()} AS toks FROM u LEFT JOIN m USING (rid)),
k AS (SELECT rid, verdict, unnest(toks) AS tok FROM t),
sets AS (SELECT rid, verdict, [tok] AS s FROM k
  UNION ALL SELECT a.rid, a.verdict, [a.tok, b.tok] FROM k a JOIN k b ON a.rid = b.rid AND a.tok < b.tok
  UNION ALL SELECT a.rid, a.verdict, [a.tok, b.tok, c.tok] FROM k a JOIN k b ON a.rid = b.rid AND a.tok < b.tok JOIN k c ON c.rid = a.rid AND b.tok < c.tok),
n AS (SELECT count(*) AS n, count(*) FILTER (verdict = 'block') / count(*)::DOUBLE AS base FROM t WHERE verdict IS NOT NULL),
mined AS (SELECT s FROM sets, n WHERE verdict IS NOT NULL GROUP BY s, n.n, n.base
  HAVING count(*) FILTER (verdict = 'block') >= ceil(0.05 * n.n) AND count(*) FILTER (verdict = 'block') / count(*)::DOUBLE >= 0.95
    AND count(*) FILTER (verdict = 'block') / count(*)::DOUBLE / n.base >= 1.2),
hit AS (SELECT DISTINCT rid FROM sets JOIN mined USING (s) WHERE verdict IS NULL)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN hit.rid IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM t LEFT JOIN hit USING (rid)
"""

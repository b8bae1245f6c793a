"""URL filters: host and path rules, then association rules from labels.

A URL's host is what follows its first ``://`` up to ``/ ? #`` or the end, A-Z
lower-cased; its path goes on up to ``? #`` or the end.  A rule (host and path
prefix) fits its host and all subdomains; the longest fitting rule decides.

For all other URLs, FP-growth mines combinations of URL tokens that go with a
label: on at least ``MIN_PAGES`` labelled pages, and mostly of one label, so
that the lower end of the share's Wilson interval (``Z`` standard deviations)
is at least ``MIN_CONFIDENCE``.  The least support is a number of pages, so a
rule that the labels bear out is found whatever else the table holds.  Mining
fits on at most about ``SAMPLE`` labelled pages, chosen by hash; that also
bounds the frequent tokens, which FP-growth keeps in the driver, by
``SAMPLE`` times the tokens of a URL over ``MIN_PAGES``.  A rule whose tokens contain another rule's tokens for
the same label without a higher confidence is pruned.  Of the rules whose
tokens a URL all has, the one of highest confidence (then support, then fewest
tokens, then the tokens' order) decides; a URL that no rule fits is allowed.

Matching goes through an inverted index: a rule is filed under its rarest
token, URLs look up their tokens, and only the rules found are checked.  URLs
are first reduced to distinct token sets.

JVM functions only (FP-growth runs distributed in Spark ML).

Defined results: null URLs and URLs without ``://`` have empty host and path,
fit no rule, and have no tokens; without labelled URLs all rests are allowed;
repeated rows get equal results; other columns are ignored."""
from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spreadforge.llm.tables import materialize, shuffled

#: fixed values: verdict, host, path
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"
#: labelled pages a rule needs, its least share of one label, and the
#: standard deviations that share is lowered by
MIN_PAGES = 20
MIN_CONFIDENCE = 0.6
Z = 1.96
#: labelled pages that rules are mined from
SAMPLE = 1_000_000
_LABEL = "label="
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule: struct of ``rule`` and ``verdict``, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(url: Column) -> Column:
    """Distinct tokens: scheme, host suffixes, path segments (numbers as one
    token, file endings apart), query keys and whether there is a fragment."""
    host, path = host_of(url), path_of(url)
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    hosts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))),
                        lambda k: F.concat(F.lit("host:"), F.array_join(F.slice(labels, -k, k), ".")))
    hosts = F.when(F.size(labels) > 0, hosts).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    plain = F.transform(parts, lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z0-9]+$", ""), r"[0-9]+", "#")))
    ending = F.transform(F.filter(parts, lambda x: x.rlike(r"\.[A-Za-z0-9]+$")), lambda x: F.concat(F.lit("end:"), F.regexp_extract(x, r"(\.[A-Za-z0-9]+)$", 1)))
    query = F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda x: x != "")
    keys = F.transform(query, lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, r"^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, r"^([A-Za-z0-9+.-]*)://", 1)))
    fragment = F.when(url.contains("#"), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    every = F.array_sort(F.array_distinct(F.concat(scheme, hosts, plain, ending, keys, fragment)))
    return F.when(url.contains("://"), every).otherwise(F.array().cast("array<string>"))


def wilson_low(share: Column, n: Column, z: float) -> Column:
    """Lower end of the Wilson interval of a share of ``n`` pages."""
    z2 = z * z
    return (share + z2 / (2 * n) - z * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def mine(labelled: DataFrame, min_support: float | None = None, min_confidence: float = MIN_CONFIDENCE,
         min_pages: int = MIN_PAGES, z: float = 0.0, sample: int = SAMPLE) -> DataFrame:
    """``tokens, verdict, confidence, support``: pruned association rules from
    ``url, verdict``.  ``min_support``, a share of the labelled pages, stands
    in for ``min_pages`` where given."""
    known = labelled.where("url is not null and verdict is not null")
    rate = min(1.0, sample / max(known.count(), 1))
    drawn = F.pmod(F.xxhash64(*known.columns), F.lit(1 << 32)) < int(rate * (1 << 32))
    items = materialize(known.where(drawn).select(F.concat(tokens_of(F.col("url")), F.array(F.concat(F.lit(_LABEL), "verdict"))).alias("items")))
    empty = labelled.sparkSession.createDataFrame([], "tokens array<string>, verdict string, confidence double, support double")
    n = items.count()
    # FP-growth rounds support * n up: half a page less is safe from rounding
    least = min_support if min_support is not None else (min_pages - 0.5) / max(n, 1)
    if n == 0 or least > 1:
        return empty
    model = FPGrowth(itemsCol="items", minSupport=least, minConfidence=min_confidence).fit(items)
    label = F.get("consequent", F.lit(0))
    rules = materialize(model.associationRules.where(
        label.startswith(_LABEL) & ~F.exists("antecedent", lambda x: x.startswith(_LABEL))).select(
        F.array_sort("antecedent").alias("tokens"), F.substring(label, F.lit(len(_LABEL) + 1), F.length(label)).alias("verdict"), "confidence", "support")
        .where(wilson_low(F.col("confidence"), F.col("support") * n / F.col("confidence"), z) >= min_confidence))
    # a longer rule must be more certain than every shorter one inside it; both are filed under the shorter one's first token
    r, s = rules.alias("r"), rules.alias("s")
    inner = (r.withColumn("token", F.explode("r.tokens"))
             .join(s.withColumn("head", F.get("s.tokens", F.lit(0))), (F.col("token") == F.col("head")) & (F.col("r.verdict") == F.col("s.verdict")))
             .where((F.size("s.tokens") < F.size("r.tokens")) & (F.size(F.array_except("s.tokens", "r.tokens")) == 0)
                    & (F.col("s.confidence") >= F.col("r.confidence"))).select(F.col("r.tokens").alias("tokens"), F.col("r.verdict").alias("verdict")).distinct())
    return rules.join(inner, ["tokens", "verdict"], "left_anti")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``set, mined``: for every distinct token set the verdict of its best
    rule.  ``urls`` has ``set`` (token arrays)."""
    sets = urls.select("set").distinct()
    rules = materialize(rules.withColumn("id", F.xxhash64("tokens", "verdict")))
    used = rules.select(F.explode("tokens").alias("token")).distinct()
    looked = sets.select("set", F.explode("set").alias("token"))
    often = looked.join(F.broadcast(used) if _few(used) else shuffled(used), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # each rule under its rarest token
    filed = (rules.withColumn("token", F.explode("tokens")).join(often, "token", "left").groupBy("id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("m"), F.first("tokens").alias("tokens"), F.first("verdict").alias("verdict"),
        F.first("confidence").alias("confidence"), F.first("support").alias("support")).select(F.col("m.token").alias("token"), "tokens", "verdict", "confidence", "support"))
    hit = looked.join(filed, "token").where(F.size(F.array_except("tokens", "set")) == 0)
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("tokens").alias("k"), "tokens", "verdict"))
    return hit.groupBy("set").agg(best.alias("b")).select("set", F.col("b.verdict").alias("mined"))


def _few(df: DataFrame, most: int = 10_000) -> bool:
    """Whether the table is small enough to send to every task."""
    return df.limit(most + 1).count() <= most


def judge(pages: DataFrame, labelled: DataFrame, rules=RULES, min_support: float | None = None, min_confidence: float = MIN_CONFIDENCE,
          min_pages: int = MIN_PAGES, z: float = Z, sample: int = SAMPLE) -> DataFrame:
    """Per page row: ``page_id, host, path, rule, verdict``."""
    url = F.col("url")
    rows = pages.select("page_id", "url").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                                                 F.coalesce(tokens_of(url), F.array().cast("array<string>")).alias("set"))
    rows = materialize(rows.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)))
    found = match(rows.where("own is null"), mine(labelled, min_support, min_confidence, min_pages, z, sample))
    return rows.join(found, "set", "left").select("page_id", "host", "path", F.col("own.rule").alias("rule"),
                                                  F.coalesce("own.verdict", "mined", F.lit(DEFAULT)).alias("verdict"))


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``page_id, url, verdict`` of pages whose document (the number in the path) has a
    quality label: block for 0, allow for 1."""
    number = F.expr(r"try_cast(regexp_extract(url, '://[^/?#]*/(?:[^?#]*/)?([0-9]{1,18})(?:[.][A-Za-z0-9]+)?/?(?:[?#]|$)', 1) AS BIGINT)")
    p = pages.select("page_id", "url", number.alias("number")).where("number is not null")
    known = labels.where("quality is not null").select("doc_id", F.when(F.col("quality") == 0, "block").otherwise("allow").alias("verdict"))
    return p.join(shuffled(known), p["number"] == known["doc_id"]).select("page_id", "url", "verdict")

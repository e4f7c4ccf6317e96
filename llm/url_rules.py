"""URL filters: allow and block rules on hosts and paths, found through hash prefixes of a url's expressions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import columns, small, stage
from llm.oracles import LOWER, UPPER

PREFIX_DIGITS = 8  # hexadecimal digits of a digest that are joined on


def host_and_path(url):
    """Columns (host, path) of a url: the host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z
    lower-cased; the path from there up to ``?``, ``#`` or the end. Both empty without ``://`` or url."""
    url, pattern = F.coalesce(url, F.lit("")), r"://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def _labels(host):
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def _digested(df, text):
    digest = F.sha2(text, 256)
    return df.withColumn("digest", digest).withColumn("short", F.substring(digest, 1, PREFIX_DIGITS))


def prepared_rules(rules: DataFrame) -> DataFrame:
    """rule, verdict, labels, chars, digest, short: the usable rules, staged. A rule with a null, with a host that holds ``/``,
    ``?`` or ``#``, or with a path that neither is empty nor starts with ``/`` fits no url and is left out."""
    rules = columns(rules, host="host", path="path", verdict="verdict").withColumn("host", F.translate("host", UPPER, LOWER))
    rules = rules.where("verdict IS NOT NULL AND NOT host RLIKE '[/?#]' AND (path = '' OR path LIKE '/%')")
    rules = rules.select(F.concat("host", "path").alias("rule"), "verdict", _labels(F.col("host")).alias("labels"),
                         F.length("path").alias("chars"))
    return stage(_digested(rules, F.col("rule")))


def expressions(urls: DataFrame, shapes) -> DataFrame:
    """``urls`` (host, path) once for each of its expressions: the host's last labels followed by the path's first
    characters, for the (labels, characters) in ``shapes``."""
    shape = F.arrays_zip(F.lit([s[0] for s in shapes]).alias("labels"), F.lit([s[1] for s in shapes]).alias("chars"))
    fits = F.filter(shape, lambda s: (s["labels"] <= _labels(F.col("host"))) & (s["chars"] <= F.length("path")))
    texts = F.transform(fits, lambda s: F.concat(
        F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substring(F.col("path"), F.lit(1), s["chars"])))
    return urls.select("host", "path", F.explode(texts).alias("expression"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col="page_id", url_col="url", default="allow") -> DataFrame:
    """``id_col``, host, path, rule, verdict of each row. ``rules``: host, path, verdict (allow or block). A rule fits the
    urls of its host and of all its subdomains whose path starts with the rule's. The longest fitting rule (host and path
    together) gives the verdict; of equal texts block wins. Without one the rule is null and the verdict ``default``.

    1. Urls are reduced to distinct (host, path), combined before the shuffle, so that a url that holds much of the table
       is looked up once.
    2. Each expands into host-suffix and path-prefix expressions, only of the (labels, characters) that some rule has:
       their number is bounded by the rules' shapes, whatever the url's length, and nothing is cut.
    3. Expressions and rules are equi-joined on the first digits of their SHA-256; equal full digests confirm a hit, and
       the best hit of a url is staged.
    4. The rows take their url's verdict by a join that adaptive execution can split.

    Null urls, urls without ``://`` and empty ones have an empty host and path and are judged as such. Null and repeated
    ids stay, row by row. Rules that repeat are one; an empty rule table gives ``default`` everywhere; an empty table
    gives no rows. Further columns are not read."""
    host, path = host_and_path(F.col("url"))
    rows = columns(pages, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"))
    rules = prepared_rules(rules)
    shapes = sorted((r.labels, r.chars) for r in rules.select("labels", "chars").distinct().collect())
    none = F.lit(None).cast("string")
    if not shapes:
        return rows.select(F.col("id").alias(id_col), "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    known = small(rules.select("short", F.col("digest").alias("rule_digest"), "rule", "verdict"))
    asked = _digested(expressions(rows.select("host", "path").distinct(), shapes), F.col("expression"))
    hits = asked.join(known, "short").where("digest = rule_digest")
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), F.col("verdict") == "block"))
    judged = stage(hits.groupBy("host", "path").agg(best.alias("best")))
    return rows.join(judged, ["host", "path"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))

"""Allow and block rules for urls, carried to aliases by redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketmatch.llm.components import components
from basketmatch.llm.scratch import stored

#: Rules that are sent to all tasks, at most.
MOST_SENT = 100_000

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def canonical(url: Column) -> Column:
    """What a url redirects to by form alone: no scheme, ``www.`` or ``m.``, tracking
    parameters, fragment, closing slash or ``.html``. Null without ``://``."""
    bare = F.regexp_replace(host(url), r"^(www|m)\.", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike("^(utm_[a-z]+|ref)=") & (p != "")), "&")
    tail = F.regexp_replace(path(url), r"(\.html|/)$", "")
    return F.when(F.instr(url, "://") > 0, F.concat(bare, tail, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def resolved(url: Column, to: Column) -> Column:
    """The url that the target ``to`` names on the page ``url``; null for one of another kind, such as ``mailto:``."""
    scheme, site = (F.regexp_extract(url, p, 1) for p in (r"(?s)^(.*?:)//", r"(?s)^(.*?://[^/?#]*)"))
    named, rest = F.regexp_extract(to, r"(?s)^([^?#]*)", 1), F.regexp_extract(to, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path(url), r"(?s)^(.*/)", 1)
    whole = F.when(named.startswith("/"), named).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), named))

    def walk(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    # The part before the first slash is empty, and stays.
    parts = F.split(whole, "/")
    steps = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), walk)
    return (
        F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to)
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(to.startswith("//"), F.concat(scheme, to))
        .when(named == "", F.concat(site, path(url), rest))
        .otherwise(F.concat(site, F.array_join(steps, "/"), rest))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): canonical urls that a page's canonical links or meta refreshes tie together."""
    html = pages.where("lower(html) like '%canonical%' or lower(html) like '%http-equiv%'").select("url", "html")
    links = F.regexp_extract_all("html", F.lit(r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"), F.lit(0))
    refreshes = F.regexp_extract_all("html", F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"), F.lit(0))
    targets = F.concat(
        F.transform(links, lambda x: F.regexp_extract(x, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)),
        F.transform(refreshes, lambda x: F.regexp_extract(x, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)", 1)),
    )
    named = html.select("url", F.explode(targets).alias("to")).where("to <> ''")
    return named.select(canonical(F.col("url")).alias("a"), canonical(resolved(F.col("url"), F.col("to"))).alias("b")).where("a <> b")


def ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for the places (host, path) that a rule fits; the longest wins.

    A host meets rules through an equality join on its suffixes.
    """
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    rules = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    sent = F.broadcast(rules) if rules.count() <= MOST_SENT else rules
    tried = places.select("host", "path", F.explode(suffixes).alias("rule_host")).join(sent, "rule_host")
    fits = tried.where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    # Of two rules of one length and name, block wins.
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule), rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, class_rule.

    ``rules`` has host, path (from its first slash) and verdict. A url that a rule
    fits has that rule's verdict. Urls are aliases if they have one canonical form or
    if redirects (meta refresh) and canonical links join their forms, over any number
    of steps. A url without a rule is blocked if an alias is blocked by a rule and no
    alias is allowed by one; else it is allowed. ``class_rule`` tells what the
    aliases' rules gave (allow, block or null).

    A null url, or one without ``://``, has an empty host and path, no rule, no
    alias, and is allowed. Null html has no links. Repeated rows are judged alike;
    extra columns are ignored.
    """
    urls = pages.select("page_id", "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "form": canonical(F.col("url"))})
    places = urls.select("host", "path").distinct()
    found = stored(ruled(places, rules), "ruled")
    same = components(page_links(pages)).withColumnsRenamed({"node": "form", "component": "class"})
    urls = urls.join(found, ["host", "path"], "left").join(same, "form", "left")
    urls = stored(urls.withColumn("class", F.coalesce("class", "form")), "urls")
    classes = urls.where("rule is not null and class is not null").groupBy("class").agg(F.min("verdict").alias("class_rule"))
    out = urls.join(classes, "class", "left")
    verdict = F.coalesce("verdict", "class_rule", F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "class_rule")

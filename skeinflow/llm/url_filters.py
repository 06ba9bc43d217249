"""URL filters: allow and block rules, and block decisions that spread over redirect-equivalent URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm.base import own, quoted
from skeinflow.llm.components import connected_components

#: (action, rule); a rule is a host and a path prefix.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that don't change what a URL shows.
TRACKING = "utm_[a-z]+|ref|gclid|fbclid"
#: So many rules are part of the plan; more are a table that is joined.
MOST_RULES = 10_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty where there is none, or url is null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_form(url: Column) -> Column:
    """http, the lower-cased host without a default port, the path without closing slashes, the query without tracking parameters, no fragment.

    Null for null and for what has no ://.
    """
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.concat(F.lit("&"), query), rf"&({TRACKING})=[^&]*", "")
    query = F.regexp_replace(F.regexp_replace(query, "^&+", ""), "(?s)^(?=.)", "?")
    form = F.concat(F.lit("http://"), F.regexp_replace(host_of(url), ":(80|443)$", ""), F.regexp_replace(path_of(url), "/+$", ""), query)
    return F.when(F.instr(url, "://") > 0, form)


#: What pages declare: a canonical link, a refresh with its attributes in either order.
CANONICAL = r"(?is)<link\b[^>]*?\brel\s*=\s*[\"']?canonical\b[^>]*>"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?is)<meta\b[^>]*?\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
TARGET = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def absolute(target: Column, url: Column) -> Column:
    """A reference resolved against the page's URL: with a scheme, a host, an absolute or a relative path, or a query alone; fragments are no other page. Null for null and empty ones."""
    base, scheme = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    here = path_of(url)
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    way = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    from_root = F.when(way.startswith("/"), way).otherwise(F.concat(F.regexp_extract(here, r"(?s)^(.*/)", 1), way))
    # . and .. are taken out part by part; either at the end leaves the folder.
    parts = F.split(F.regexp_replace(from_root, "^/", ""), "/")
    step = lambda out, p: F.when(p == ".", out).when(p == "..", F.regexp_replace(out, "/[^/]*$", "")).otherwise(F.concat(out, F.lit("/"), p))
    folded = F.concat(F.aggregate(parts, F.lit(""), step), F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    whole = F.when(F.instr(target, "://") > 0, target).when(target.startswith("//"), F.concat(scheme, target)).when(target.startswith("?"), F.concat(base, here, target))
    return F.when((target != "") & ~target.startswith("#"), whole.otherwise(F.concat(base, folded, rest)))


def declared_targets(html: Column, url: Column) -> Column:
    """The targets of link rel=canonical and of meta refresh, made absolute; null where there is none, or url has no ://."""
    found = (F.regexp_extract(F.regexp_extract(html, tag, 0), target, 1) for tag, target in ((CANONICAL, HREF), (REFRESH, TARGET)))
    return F.array(*(F.when(F.instr(url, "://") > 0, absolute(t, url)) for t in found))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, action) of the longest rule that fits, else null. Of equal rules with both actions, allow wins."""
    by_host: dict[str, dict[str, str]] = {}
    for action, rule in rules:
        at, _, rest = rule.partition("/")
        had = by_host.setdefault(at, {})
        had["/" + rest] = "allow" if "allow" in (action, had.get("/" + rest)) else action
    if not by_host:
        return F.lit(None).cast("struct<size:int,rule:string,action:string,path:string>")
    entry = lambda h, p, a: F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(a).alias("action"), F.lit(p).alias("path"))
    table = F.create_map(*(x for h, paths in by_host.items() for x in (F.lit(h), F.array(*(entry(h, p, a) for p, a in paths.items())))))
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(fits, lambda r: path.startswith(r["path"])))


def ruled(rows: DataFrame, url: str, rules, host: str, path: str, name: str) -> DataFrame:
    """rows with host, path, and name: struct(rule, action) of the longest rule that fits, else null.

    Rules are pairs (action, rule), or a DataFrame of them. Some thousand are part of the plan; a longer list, and a
    table, is joined to the URLs' hosts and the domains above them.
    """
    rows = rows.withColumns({host: host_of(F.col(quoted(url))), path: path_of(F.col(quoted(url)))})
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        if len(rules) <= MOST_RULES:
            got = rule_for(F.col(host), F.col(path), rules)
            return rows.withColumn(name, F.struct(got["rule"].alias("rule"), got["action"].alias("action")))
        rules = rows.sparkSession.createDataFrame(rules, "action string, rule string")
    rules = rules.select(F.col("rule").alias("rule"), (F.col("action") == "allow").alias("allow")).where("rule is not null")
    rules = rules.groupBy("rule").agg(F.max("allow").alias("allow")).select(F.regexp_extract("rule", "^([^/]*)", 1).alias("at"), F.concat(F.lit("/"), F.regexp_extract("rule", "(?s)^[^/]*/?(.*)$", 1)).alias("prefix"), "rule", F.when(F.col("allow"), "allow").otherwise("block").alias("action"))
    # Hosts and paths repeat: each pair meets the rules once.
    pairs = rows.select(F.col(host).alias("h"), F.col(path).alias("p")).distinct()
    labels = F.split("h", r"\.")
    above = pairs.select("h", "p", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("at"))
    fits = above.join(rules, "at").where(F.col("p").startswith(F.col("prefix")))
    h2, p2 = own(rows, "__h", "__p")
    best = fits.groupBy(F.col("h").alias(h2), F.col("p").alias(p2)).agg(F.max_by(F.struct("rule", "action"), F.length("rule")).alias(name))
    return rows.join(best, (F.col(host) == F.col(h2)) & (F.col(path) == F.col(p2)), "left").drop(h2, p2)


def alias_edges(pages: DataFrame, url: str = "url", html: str | None = "html") -> DataFrame:
    """(a, b): each URL with its canonical form and with the targets that its page declares."""
    u = F.col(quoted(url))
    ends = F.array(canonical_form(u))
    if html:
        ends = F.concat(ends, declared_targets(F.col(quoted(html)), u))
    # A declared target is a URL like any other: it is an alias of its own canonical form too.
    links = pages.select(u.alias("a"), F.explode(ends).alias("b")).where("a is not null and b is not null")
    return links.union(links.select(F.col("b").alias("a"), canonical_form(F.col("b")).alias("b"))).where("a <> b").distinct()


def judge_urls(pages: DataFrame, rules=RULES, url: str = "url", html: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict (a name that is taken gets a _).

    Redirects (a, b), canonical links, refreshes and canonical forms are edges; their connected components are classes
    of aliases. rules are (action, rule) pairs or a DataFrame of them.
    A page that a rule fits has that rule's verdict. Any other is blocked if a rule blocks some URL of its class and
    none allows one: an explicit allow takes precedence. Null URLs, and those without ://, have an empty host and path
    and are allowed; repeated rows each get their verdict; an empty table gives no rows.
    """
    edges = alias_edges(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.toDF("a", "b"))
    classes = connected_components(edges)
    said = ruled(classes, "node", rules, "host", "path", "fit").select("root", F.col("fit.action").alias("action"))
    # A class's verdict goes back to its nodes by a join, not a window: a hub's class may hold a third of all URLs.
    said = said.groupBy("root").agg(F.max(F.col("action") == "allow").alias("allowed"), F.max(F.col("action") == "block").alias("blocked"))
    spread = said.where("blocked and not coalesce(allowed, false)").select("root")
    host, path, rule, verdict, fit, node, hit = own(pages, "host", "path", "rule", "verdict", "__rule", "__node", "__hit")
    blocked = classes.join(spread, "root", "left_semi").select(F.col("node").alias(node), F.lit(True).alias(hit))
    out = ruled(pages, url, rules, host, path, fit).join(blocked, F.col(quoted(url)) == F.col(node), "left")
    own_verdict = F.coalesce(F.col(f"{fit}.action"), F.when(F.col(hit), "block").otherwise("allow"))
    return out.withColumns({rule: F.col(f"{fit}.rule"), verdict: own_verdict}).select(*map(quoted, pages.columns), host, path, rule, verdict)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each page; null and odd URLs, repeats and empty tables as in judge_urls()."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def url_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts over redirects made up from the pages' ids, as pages declare none themselves: to the page of half the id, or to an old net address. Rules come as a table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    half = pages.select((F.col("page_id") * 2).alias("two"), F.col("url").alias("to"))
    to = F.when(F.col("page_id") % 3 == 0, F.col("to")).when(F.col("page_id") % 7 == 0, F.concat(F.lit("http://old.net/"), F.when(F.col("page_id") % 2 == 0, "es").otherwise("de"), F.lit("/"), F.col("page_id").cast("string")))
    redirects = pages.join(half, F.col("page_id") - F.col("page_id") % 2 == F.col("two"), "left").select("url", to.alias("b")).where("b is not null")
    rules = spark.createDataFrame(RULES, "action string, rule string").where("rule <> 'com/'")
    return judge_urls(pages, rules, html=None, redirects=redirects).select("page_id", "host", "path", "rule", "verdict")


def _sql_form(u: str) -> str:
    host = rf"regexp_replace(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), ':(80|443)$', '')"
    path = rf"regexp_replace(regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '')"
    query = rf"regexp_replace(regexp_replace('&' || regexp_extract({u}, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&({TRACKING})=[^&]*', '', 'g'), '^&+', '')"
    return f"case when instr({u}, '://') > 0 then 'http://' || {host} || {path} || case when {query} = '' then '' else '?' || {query} end end"


def _sql(links: str, rules=RULES) -> str:
    """DuckDB SQL of verdicts, links (a, b) beside canonical forms given as SQL."""
    return rf"""
with recursive rules(action, r) as (values {", ".join(f"('{a}', '{r}')" for a, r in rules)}),
rule as (select action, r, split_part(r, '/', 1) as rh, substr(r, strpos(r, '/')) as rp from rules),
{links},
links as (select url as a, {_sql_form("url")} as b from pages union select a, b from declared),
edges as (select a, b from links where a is not null and b is not null and a <> b union select b, {_sql_form("b")} from links where a is not null and b is not null and b <> {_sql_form("b")}),
sym as (select a, b from edges union select b, a from edges),
reach as (select a, a as b from sym union select r.a, s.b from reach r join sym s on r.b = s.a),
split as (select distinct u, coalesce(translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') as host,
  coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from (select url as u from pages union select a from sym)),
fit as (select u, host, path, max_by(r, length(r)) as rule, max_by(action, length(r)) as action from split left join rule
  on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp) group by 1, 2, 3),
class as (select reach.a as u, bool_or(action = 'allow') as allowed, bool_or(action = 'block') as blocked from reach join fit on reach.b = fit.u group by 1)
select page_id, coalesce(fit.host, '') as host, coalesce(fit.path, '') as path, fit.rule as rule,
  coalesce(fit.action, case when blocked and not coalesce(allowed, false) then 'block' else 'allow' end) as verdict
from pages left join fit on fit.u = pages.url left join class on class.u = pages.url
"""


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


ORACLE = _sql(rf"""found as (select url, unnest([regexp_extract(regexp_extract(html, '{_quoted(CANONICAL)}', 0), '{_quoted(HREF)}', 1), regexp_extract(regexp_extract(html, '{_quoted(REFRESH)}', 0), '{_quoted(TARGET)}', 1)]) as t,
  regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) as base, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) as here from pages where instr(url, '://') > 0),
parted as (select *, regexp_extract(t, '(?s)^([^?#]*)', 1) as way, regexp_extract(t, '(?s)^[^?#]*(.*)$', 1) as rest from found where t <> '' and not starts_with(t, '#')),
pathed as (select *, string_split(regexp_replace(case when starts_with(way, '/') then way else regexp_extract(here, '(?s)^(.*/)', 1) || way end, '^/', ''), '/') as parts from parted),
folded as (select *, list_reduce(list_prepend('', parts), lambda x, p: case when p = '.' then x when p = '..' then regexp_replace(x, '/[^/]*$', '') else x || '/' || p end) || case when parts[-1] in ('.', '..') then '/' else '' end as f from pathed),
declared as (select url as a, case when instr(t, '://') > 0 then t when starts_with(t, '//') then regexp_extract(url, '(?s)^(.*?:)//', 1) || t when starts_with(t, '?') then base || here || t else base || f || rest end as b from folded)""")
ALIASES = _sql(f"declared as (select p.url as a, case when p.page_id % 3 = 0 then h.url when p.page_id % 7 = 0 then 'http://old.net/' || case when p.page_id % 2 = 0 then 'es' else 'de' end || '/' || p.page_id end as b from pages p left join pages h on h.page_id * 2 = p.page_id - p.page_id % 2)", [r for r in RULES if r[1] != "com/"])

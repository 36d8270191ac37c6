"""URL verdicts: ordered rules first, then the path templates of each host.

The distinct paths of a host form a tree of segments. A place of the tree is what comes before a
segment, by form: numbers, numbers with an ending, long identifiers, words. At a place, words that
hold a twentieth of its paths or more stay as they are, at most twenty of them; all rarer ones are a
wildcard, and numbers and identifiers are wildcards anywhere. Shares of distinct paths decide, so
neither repeated rows nor the size of a host do. Each depth has its places, however deep paths are.

The branches of a place, one for each word that stays, merge when they are statistically similar:
the same forms of what follows hold a tenth of each or more. Where such branches have labels that
disagree (smoothed purity on both sides of one half), only those that agree merge; and a branch
without labels that should have three or more, at the rate of the others, is not like them either.

A template is rejected when the smoothed share of blocked ones among its labelled paths is one half
or more. Smoothing adds ``WEIGHT`` paths of the host's estimate, on which templates without labels
rest alone: there every path counts, those without a label by the prior share, so a host is held
against its templates only as far as labels cover it. Labels are the verdicts of the rules.

All of it is DataFrame operations. Counting is done per distinct (host, form of path), combined
before any shuffle; urls meet their template again in an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import small, written

#: (rule, verdict): a host, which stands for its subdomains too, and the start of a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Smoothing: the share of unwanted paths among unlabelled ones, and how many paths of its host's estimate a template gets.
PRIOR, WEIGHT = 0.2, 2.0
#: So many labels, expected but absent, tell a branch from those with labels.
_ABSENT = 3
#: A word stays where it holds one in this many paths of its place; a form counts where it holds one in this many of its branch.
_STAYS, _MAIN = 20, 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or lacks ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, else null."""
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    known = F.array(*[F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path")) for r, v in rules])
    fits = F.filter(known, lambda r: ((host == r.host) | F.endswith(host, F.concat(F.lit("."), r.host))) & F.startswith(path, r.path))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["size"].alias("size"), r.rule.alias("rule"), r.verdict.alias("verdict"))))


def _form(x: Column) -> Column:
    """A wildcard for numbers, numbers with an ending and long identifiers; words as they are, < and > in them as ( and )."""
    return (
        F.when(x.rlike(r"^[0-9]+$"), F.lit("<n>"))
        .when(x.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("<n>"), F.regexp_replace(x, r"^[0-9]+", "")))
        .when((F.length(x) >= 8) & x.rlike(r"[0-9]"), F.lit("<id>"))
        .otherwise(F.translate(x, "<>", "()"))
    )


_BLANK = "<w>"


def _sums() -> list[Column]:
    """Sums of paths: all, those with a label, and those blocked."""
    return [F.expr(f"sum({c}) AS {c}") for c in ("n", "labelled", "blocked")]


def templates(nodes: DataFrame) -> DataFrame:
    """(host, form, template, purity) of (host, form, n, labelled, blocked): ``form`` is a path's segments by form, parted by slashes, n its paths."""
    parts = "if(form = '', array(), split(form, '/'))"
    # a place is named by a hash of the forms before it, what follows by one of the forms behind
    kinds = f"transform({parts}, x -> if(startswith(x, '<'), x, '{_BLANK}'))"
    cut = nodes.selectExpr("*", f"{parts} AS parts", f"{kinds} AS kinds")
    steps = cut.selectExpr("host", "form", "n", "labelled", "blocked", "kinds", "posexplode(parts) AS (i, value)")
    steps = steps.selectExpr("host", "form", "n", "labelled", "blocked", "i", "value", "startswith(value, '<') AS wild", "xxhash64(i, array_join(slice(kinds, 1, i), '/')) AS place", "if(i + 2 > size(kinds), '', array_join(slice(kinds, i + 2, size(kinds)), '/')) AS behind")
    steps = written(steps)
    words = steps.where("not wild").groupBy("host", "place", "value").agg(*_sums())
    whole = steps.groupBy("host", "place").agg(F.expr("sum(n) AS whole"))
    stays = written(words.join(whole, ["host", "place"]).where(f"{_STAYS} * n >= whole").drop("whole"))
    met = steps.where("not wild").join(small(stays.select("host", "place", "value", F.col("n").alias("branch")), 100_000), ["host", "place", "value"])
    main = met.groupBy("host", "place", "value", "branch", "behind").agg(F.expr("sum(n) AS m")).where(f"{_MAIN} * m >= branch")
    # a branch has ten forms of a tenth at most
    alike = main.groupBy("host", "place", "value").agg(F.expr("to_json(sort_array(collect_list(behind))) AS shape"))
    side = f"CASE WHEN labelled = 0 THEN 0 WHEN (blocked + {PRIOR}D) / (labelled + 1) >= 0.5D THEN 1 ELSE -1 END AS side"
    branches = stays.join(alike, ["host", "place", "value"], "left").selectExpr("host", "place", "value", "coalesce(shape, concat('=', value)) AS shape", "n", "labelled", side)
    split = branches.groupBy("host", "place", "shape").agg(F.expr("max(side) = 1 AND min(side) = -1 AS mixed"), F.expr("sum(n) AS all_n"), F.expr("sum(labelled) AS all_labelled"))
    family = f"if(mixed OR labelled = 0 AND n * all_labelled >= {_ABSENT} * all_n, side, 2) AS family"
    branches = branches.join(split, ["host", "place", "shape"]).selectExpr("host", "place", "value", "shape", family)
    first = branches.groupBy("host", "place", "shape", "family").agg(F.expr("min(value) AS first"), F.expr("count(*) AS c"))
    names = branches.join(first, ["host", "place", "shape", "family"]).selectExpr("host", "place", "value", "if(c > 1, concat(first, '~'), value) AS name")
    names = small(written(names), 100_000)
    named = steps.join(names, ["host", "place", "value"], "left").selectExpr("host", "form", "i", f"if(wild, value, coalesce(name, '{_BLANK}')) AS name")
    lines = named.groupBy("host", "form").agg(F.expr("array_join(transform(sort_array(collect_list(struct(i, name))), x -> x.name), '/') AS line"))
    placed = written(nodes.join(lines, ["host", "form"], "left").selectExpr("host", "form", "concat_ws('/', host, coalesce(line, '')) AS template", "n", "labelled", "blocked"))
    share = f"(blocked + {PRIOR}D * (n - labelled + 1)) / (n + 1)"
    hosts = placed.groupBy("host").agg(*_sums()).selectExpr("host", f"{share} AS of_host")
    sums = placed.groupBy("host", "template").agg(*_sums()).join(hosts, "host")
    pure = sums.selectExpr("template", f"(blocked + {WEIGHT}D * of_host) / (labelled + {WEIGHT}D) AS purity")
    return placed.select("host", "form", "template").join(pure, "template").select("host", "form", "template", "purity")


def judge(pages: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity), a row for each input row.

    A null url, or one without ``://``, has empty host and path, matches no rule and is judged with
    the other urls of the empty host. Repeated rows come back as often as they come and count once.
    Empty segments do not count. Null ids stay null. Extra columns are ignored; an empty table gives
    an empty result.
    """
    host, path = host_and_path(F.col("__url"))
    seen = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    seen = seen.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    form = F.array_join(F.transform(F.filter(F.split("path", "/"), lambda x: x != ""), _form), "/")
    urls = written(seen.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"), form.alias("form")))
    paths = urls.groupBy("host", "path", "form").agg(F.expr("max(ruled) AS ruled"))
    nodes = written(paths.groupBy("host", "form").agg(F.expr("count(*) AS n"), F.expr("count(ruled) AS labelled"), F.expr("count_if(ruled = 'block') AS blocked")))
    found = small(written(templates(nodes)), 100_000)
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= 0.5, "block").otherwise("allow"))
    return urls.join(found, ["host", "form"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


#: DuckDB SQL of (page_id, host, path, rule, verdict, template, purity) for the rules above, from their definition: one row for each
#: distinct path and segment, window functions for shares, and lists of the forms before and behind a segment.
ORACLE = r"""
WITH split AS (
  SELECT row_number() OVER () AS k, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT k, page_id, coalesce(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 1), '') AS raw, coalesce(regexp_extract(coalesce(rest, ''), '^([^/?#]*)([^?#]*)', 2), '') AS path FROM split),
urls AS (SELECT k, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM cut),
ruled AS (
  SELECT *, ('.' || host) LIKE '%.com' AS com, ('.' || host) LIKE '%.net' AS net, ('.' || host) LIKE '%.org' AS org, ('.' || host) LIKE '%.example.com' AS excom, ('.' || host) LIKE '%.example.net' AS exnet FROM urls),
judged AS (
  SELECT k, page_id, host, path,
    CASE WHEN exnet AND starts_with(path, '/de/8') THEN 'example.net/de/8' WHEN excom AND starts_with(path, '/en/7') THEN 'example.com/en/7' WHEN com AND starts_with(path, '/en/') THEN 'com/en/' WHEN net AND starts_with(path, '/de/') THEN 'net/de/' WHEN org AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM ruled),
paths AS (SELECT DISTINCT host, path, rule FROM judged),
labels AS (
  SELECT host, path, CASE WHEN rule IS NULL THEN 0 ELSE 1 END AS known, CASE WHEN rule IN ('example.net/de/8', 'com/en/', 'org/es/') THEN 1 ELSE 0 END AS bad, list_filter(string_split(path, '/'), lambda x: len(x) > 0) AS raw FROM paths),
shaped AS (
  SELECT host, path, known, bad, list_transform(raw, lambda x: CASE WHEN NOT regexp_matches(x, '[^0-9]') THEN '<n>' WHEN regexp_matches(x, '^[0-9]+\.[A-Za-z0-9]+$') THEN '<n>.' || split_part(x, '.', 2) WHEN length(x) > 7 AND regexp_matches(x, '[0-9]') THEN '<id>' ELSE translate(x, '<>', '()') END) AS seg FROM labels),
kinds AS (SELECT *, list_transform(seg, lambda x: CASE WHEN x[1] = '<' THEN x ELSE '<w>' END) AS kind FROM shaped),
steps AS (SELECT host, path, known, bad, i, seg[i] AS value, kind[:i - 1] AS place, kind[i + 1:] AS behind FROM kinds, unnest(generate_series(1, len(seg))) AS t(i)),
words AS (
  SELECT *, count(*) OVER (PARTITION BY host, i, place) AS whole, count(*) OVER (PARTITION BY host, i, place, value) AS branch, sum(known) OVER (PARTITION BY host, i, place, value) AS known_branch,
    sum(bad) OVER (PARTITION BY host, i, place, value) AS bad_branch, count(*) OVER (PARTITION BY host, i, place, value, behind) AS follow FROM steps),
stay AS (
  SELECT host, i, place, value, list(DISTINCT behind ORDER BY behind) FILTER (10 * follow >= branch) AS shape, any_value(CASE WHEN known_branch = 0 THEN 0 WHEN (bad_branch + 0.2::DOUBLE) / (known_branch + 1) >= 0.5::DOUBLE THEN 1 ELSE -1 END) AS side,
    any_value(branch) AS branch, any_value(known_branch) AS known_branch
  FROM words WHERE value[1] <> '<' AND 20 * branch >= whole GROUP BY host, i, place, value),
kin AS (SELECT *, CASE WHEN shape IS NULL THEN value END AS lone, max(side) OVER w - min(side) OVER w = 2 AS mixed, known_branch = 0 AND branch * sum(known_branch) OVER w >= 3 * sum(branch) OVER w AS bare FROM stay WINDOW w AS (PARTITION BY host, i, place, shape, CASE WHEN shape IS NULL THEN value END)),
named AS (
  SELECT host, i, place, value, CASE WHEN count(*) OVER w > 1 THEN min(value) OVER w || '~' ELSE value END AS name FROM kin
  WINDOW w AS (PARTITION BY host, i, place, shape, lone, CASE WHEN mixed OR bare THEN side ELSE 2 END)),
lines AS (
  SELECT s.host, s.path, string_agg(CASE WHEN s.value[1] = '<' THEN s.value ELSE coalesce(n.name, '<w>') END, '/' ORDER BY s.i) AS line
  FROM steps s LEFT JOIN named n ON s.host = n.host AND s.i = n.i AND s.place = n.place AND s.value = n.value GROUP BY s.host, s.path),
placed AS (SELECT l.host, l.path, known, bad, l.host || '/' || coalesce(line, '') AS template FROM labels l LEFT JOIN lines USING (host, path)),
hosts AS (SELECT host, (sum(bad) + 0.2::DOUBLE * (count(*) - sum(known) + 1)) / (count(*) + 1) AS of_host FROM placed GROUP BY host),
pure AS (
  SELECT template, any_value(placed.host) AS host, (sum(bad) + 2.0::DOUBLE * any_value(of_host)) / (sum(known) + 2.0::DOUBLE) AS purity FROM placed JOIN hosts ON placed.host = hosts.host GROUP BY template)
SELECT j.page_id, j.host, j.path, j.rule, CASE WHEN j.rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN j.rule IS NOT NULL THEN 'block' WHEN p.purity >= 0.5 THEN 'block' ELSE 'allow' END AS verdict, p.template, p.purity
FROM judged j JOIN placed d ON j.host = d.host AND j.path = d.path JOIN pure p ON p.template = d.template"""


def oracle() -> str:
    return ORACLE

"""URL filter: a path-template tree per host whose templates are judged by smoothed labelled purity.

URLs that a rule decides are the labelled ones. Level by level, each node (host and template so far) keeps the path
segments that make up a fair share of its URLs and generalises all others to ``*``. Of the kept sisters, those that a G-test
cannot tell from the commonest one, by the shapes and labels of the URLs below, are merged with it into one branch; the others
stay. A node of fewer than ``MIN_URLS`` URLs is not split any further, and the tree grows until no node is left to split.

A template's purity is the share of blocked URLs among its labelled ones, smoothed by the purity of its host, which is smoothed
by that of all URLs. A template of ``MIN_LABELS`` labelled URLs and a purity at or above ``REJECT`` is rejected, and with it
its URLs without a label. Without that support nothing is rejected.

Everything is joins and aggregates of built-in functions. Rows are first added up by host and path, no group is ever collected,
and the one list that is (the branches of a node) cannot be longer than ``1 / MIN_SHARE``. Rows of a hot host meet its tree in
``SALTS`` tasks. Judged paths, as many as the input has, are joined to the rows as they are; only those of the hot paths, at most
``1 / HOT_SHARE``, whose hashes the driver holds, are copied. Copies are never broadcast: their number is not in Spark's estimate.

Defined cases: a url that is null or has no ``://`` has an empty host and path; such rows form a template of their own. What lies
below a node that is not split is one wildcard ``**``; very long paths cost a level only where ``MIN_URLS`` URLs share them. Repeated
rows are judged alike. Without labels all is allowed. No rows give no rows. Columns other than the id and the url are not read;
the id may be null or repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crawlgrain.llm.common import Scratch, read_table

#: (host and path, verdict): a rule fits its host and subdomains where the url's path starts with its path.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Least share of a node's URLs for a segment to stay literal, and its least number of URLs.
MIN_SHARE, MIN_URLS = 0.02, 3
#: Weight of the prior; labelled URLs and purity from which a template is rejected.
PRIOR_WEIGHT, MIN_LABELS, REJECT = 10.0, 5, 0.75
#: Quantile of the normal distribution from which sisters differ: 95 of 100 alike ones are merged.
QUANTILE = 1.645
#: Parts that the rows of a host are dealt out to where they meet its tree.
SALTS = 16
#: Share of all rows, and least number of them, from which a path is hot.
HOT_SHARE, HOT_ROWS = 0.001, 64
#: Levels that the SQL check spells out.
CHECKED_LEVELS = 8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_sql(url: str) -> tuple[str, str]:
    """SQL of host and path."""
    rest = f"substring({url}, locate('://', {url}) + 3)"
    there = f"coalesce(locate('://', {url}) > 0, false)"
    host = f"CASE WHEN {there} THEN translate(regexp_extract({rest}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') ELSE '' END"
    path = f"CASE WHEN {there} THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END"
    return host, path


def rule_sql(rules: dict[str, str], host: str = "host", path: str = "path") -> tuple[str, str]:
    """SQL of the longest fitting rule and of its verdict, null where none fits."""
    which, says = [], []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        own = rule.index("/")
        fits = f"(concat('.', {host}) LIKE '%.{rule[:own]}' AND startswith({path}, '{rule[own:]}'))"
        which.append(f"WHEN {fits} THEN '{rule}'")
        says.append(f"WHEN {fits} THEN '{rules[rule]}'")
    return f"CASE {' '.join(which)} END", f"CASE {' '.join(says)} END"


def shape_sql(segment: str) -> str:
    """The kind of a path segment; none (null) where the path ends."""
    return (f"CASE WHEN {segment} IS NULL THEN 'end' WHEN {segment} RLIKE '^[0-9]+$' THEN 'number' "
            f"WHEN {segment} RLIKE '[0-9]' THEN 'mixed' ELSE 'word' END")


def critical_sql(freedom: str) -> str:
    """The value that a chi-square of so many degrees of freedom rarely passes (Wilson and Hilferty's approximation)."""
    return f"{freedom} * power(1 - 2e0 / (9 * {freedom}) + {QUANTILE}e0 * sqrt(2e0 / (9 * {freedom})), 3)"


def purity_sql(blocked: str, allowed: str, prior: str) -> str:
    return f"({blocked} + {PRIOR_WEIGHT}e0 * {prior}) / ({blocked} + {allowed} + {PRIOR_WEIGHT}e0)"


def _salted(left: DataFrame, right: DataFrame, keys: list[str], salt: str, how: str = "left", hot: str = "true") -> DataFrame:
    """Join with rows of ``left`` whose keys are ``hot`` dealt out by ``salt`` and those of ``right``, few for each key, copied.

    A broadcast is ruled out: what it would weigh is judged by the files of ``right``, packed and without the copies."""
    dealt = left.withColumn("_salt", F.expr(f"IF({hot}, pmod(xxhash64({salt}), {SALTS}), 0L)"))
    copied = right.withColumn("_salt", F.expr(f"explode(IF({hot}, sequence(0L, {SALTS - 1}L), array(0L)))"))
    return dealt.join(copied.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def _hot_sql(found: DataFrame) -> str:
    """SQL of whether a path is hot: by its hash, of which ``1 / HOT_SHARE`` at most are held."""
    total = found.agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("n") >= max(HOT_ROWS, HOT_SHARE * total)).selectExpr("xxhash64(host, segments) AS key").collect()
    return f"xxhash64(host, segments) IN ({', '.join(f'{r.key}L' for r in hot)})" if hot else "false"


def _branches(live: DataFrame, level: int) -> DataFrame:
    """host, template, total and branches (lists of merged segments) of the nodes that ``live`` rows lie in."""
    node, x = ["host", "template"], (lambda n: f"{n} * ln({n})")
    kinds = live.selectExpr(*node, f"get(segments, {level}) AS segment", f"{shape_sql(f'get(segments, {level + 1})')} AS shape",
                            "stack(3, 'block', blocked, 'allow', allowed, 'none', unlabelled) AS (label, n)").where("n > 0")
    kinds = kinds.groupBy(*node, "segment", "shape", "label").agg(F.sum("n").alias("n"))
    parents = kinds.groupBy(*node).agg(F.sum("n").alias("total"))
    own = kinds.groupBy(*node, "segment").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    kept = own.join(parents, node).where(f"n >= {MIN_SHARE}D * total AND n >= {MIN_URLS}").select(*node, "segment", "n", "kinds")
    leader = kept.groupBy(*node).agg(F.min(F.struct((-F.col("n")).alias("n"), "segment", "kinds")).alias("first")).selectExpr(
        *node, "first.segment AS leader", "-first.n AS leader_n", "first.kinds AS leader_kinds")
    # Kinds that only one of the two has add nothing to the sum.
    of_leader = kinds.join(leader, node).where("segment = leader").selectExpr(*node, "shape", "label", "n AS leader_n")
    common = kinds.join(of_leader, [*node, "shape", "label"]).groupBy(*node, "segment").agg(
        F.sum(F.expr(f"{x('n')} + {x('leader_n')} - {x('(n + leader_n)')}")).alias("s"), F.count("*").alias("both"))
    tested = kept.join(leader, node).join(common, [*node, "segment"], "left").selectExpr(
        *node, "segment", "leader_kinds + kinds - coalesce(both, 0) - 1 AS freedom",
        f"2 * (coalesce(s, 0) - {x('n')} - {x('leader_n')} + {x('(n + leader_n)')}) AS g")
    marked = tested.selectExpr(*node, "segment", f"IF(freedom = 0 OR g <= {critical_sql('nullif(freedom, 0)')}, '', segment) AS mark")
    lists = marked.groupBy(*node, "mark").agg(F.array_sort(F.collect_set("segment")).alias("sisters"))
    # At most 1 / MIN_SHARE segments of a node: one row with all its branches.
    tree = lists.groupBy(*node).agg(F.collect_list("sisters").alias("branches"))
    return parents.join(tree, node, "left")


def judge_templates(paths: DataFrame, work: Scratch) -> DataFrame:
    """``paths`` (host, segments, blocked, allowed, unlabelled) -> host, segments, template, purity, labels, n (rows)."""
    hosts = paths.groupBy("host").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    # The purity of all URLs is one number.
    whole = hosts.agg(F.sum("b").alias("b"), F.sum("a").alias("a")).selectExpr("b / nullif(b + a, 0) AS p").first().p or 0.0
    prior = work.write(hosts.selectExpr("host", f"{purity_sql('b', 'a', f'{whole!r}D')} AS host_purity"), "hosts")
    state = work.write(paths.withColumns({"template": F.lit(""), "done": F.expr("size(segments) = 0")}), "level0")
    level = 0
    while True:
        live = state.where("NOT done")
        if live.isEmpty():
            break
        here = f"get(segments, {level})"
        grown = f"coalesce(array_join(get(filter(branches, s -> array_contains(s, {here})), 0), '+'), '*')"
        stepped = _salted(live, work.write(_branches(live, level), f"tree{level}"), ["host", "template"], "segments").selectExpr(
            "host", "segments", "blocked", "allowed", "unlabelled",
            f"concat(template, '/', IF(total < {MIN_URLS}, '**', {grown})) AS template",
            f"total < {MIN_URLS} OR size(segments) = {level + 1} AS done")
        state = work.write(state.where("done").unionByName(stepped), f"level{level + 1}")
        work.drop(f"level{level}", f"tree{level}")
        level += 1
    sums = state.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    purity = sums.join(prior, "host").selectExpr("host", "template", "a + b AS labels", f"{purity_sql('b', 'a', 'host_purity')} AS purity")
    return _salted(state, purity, ["host", "template"], "segments", "inner").selectExpr(
        "host", "segments", "template", "purity", "labels", "blocked + allowed + unlabelled AS n")


def filter_urls(pages: DataFrame, rules: dict[str, str] | None = None, id_column: str = "page_id") -> DataFrame:
    """One row per url: id, host, path, rule, verdict, template and purity."""
    host, path = split_sql("url")
    rule, says = rule_sql(RULES if rules is None else rules)
    work = Scratch(pages.sparkSession, "url-filter")
    parsed = pages.selectExpr(f"`{id_column}`", f"{host} AS host", f"{path} AS path")
    judged = parsed.selectExpr("*", f"{rule} AS rule", f"{says} AS label", "filter(split(path, '/'), s -> s <> '') AS segments")
    paths = judged.groupBy("host", "segments").agg(
        F.count_if(F.expr("label = 'block'")).alias("blocked"), F.count_if(F.expr("label = 'allow'")).alias("allowed"),
        F.count_if(F.expr("label IS NULL")).alias("unlabelled"))
    found = work.write(judge_templates(paths, work), "judged")
    return _salted(judged, found.drop("n"), ["host", "segments"], f"`{id_column}`", hot=_hot_sql(found)).selectExpr(
        f"`{id_column}`", "host", "path", "rule",
        f"coalesce(label, IF(purity >= {REJECT} AND labels >= {MIN_LABELS}, 'block', 'allow')) AS verdict", "template",
        "round(purity, 6) AS purity")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))


def oracle() -> str:
    """The same with windows over the rows, one common table expression per level."""
    which = "CASE " + " ".join(
        f"WHEN ('.' || host) LIKE '%.{r[:r.index('/')]}' AND starts_with(path, '{r[r.index('/'):]}') THEN '{r}'"
        for r in sorted(RULES, key=len, reverse=True)) + " END"
    says = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items()) + " END"
    rest = "substr(url, strpos(url, '://') + 3)"
    blocked = lambda over: f"count(*) FILTER (label = 'block') {over}"
    allowed = lambda over: f"count(*) FILTER (label = 'allow') {over}"
    smooth = lambda over, prior: purity_sql(blocked(over), allowed(over), prior)
    x = lambda n: f"{n} * ln({n})"
    steps = [f"""
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract({rest}, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
             CASE WHEN strpos(url, '://') > 0 THEN regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r AS (SELECT *, {which} AS rule FROM u),
l AS (SELECT *, {says} AS label, list_filter(string_split(path, '/'), lambda s: s <> '') AS segments FROM r),
whole AS (SELECT coalesce(count(*) FILTER (label = 'block') / nullif(count(label), 0), 0) AS p FROM l),
t0 AS (SELECT l.*, {smooth('OVER (PARTITION BY host)', '(SELECT p FROM whole)')} AS host_purity, '' AS template, len(segments) = 0 AS done FROM l)"""]
    shape = lambda s: (f"CASE WHEN {s} IS NULL THEN 'end' WHEN regexp_matches({s}, '^[0-9]+$') THEN 'number' "  # noqa: E731
                       f"WHEN regexp_matches({s}, '[0-9]') THEN 'mixed' ELSE 'word' END")
    for k in range(CHECKED_LEVELS):
        steps.append(f"""
s{k} AS (SELECT *, segments[{k + 1}] AS segment, {shape(f'segments[{k + 2}]')} || coalesce(label, '') AS kind,
                count(*) OVER (PARTITION BY host, template) AS total FROM t{k} WHERE NOT done),
k{k} AS (SELECT host, template, segment, kind, count(*) AS n FROM s{k} GROUP BY ALL),
o{k} AS (SELECT host, template, segment, sum(n) AS n, count(*) AS kinds FROM k{k} GROUP BY ALL),
e{k} AS (SELECT * FROM o{k} WHERE n >= {MIN_URLS} AND n >= {MIN_SHARE} * (SELECT sum(n) FROM o{k} p WHERE p.host = o{k}.host AND p.template = o{k}.template)),
f{k} AS (SELECT host, template, segment AS leader, n AS leader_n, kinds AS leader_kinds FROM e{k}
         QUALIFY row_number() OVER (PARTITION BY host, template ORDER BY n DESC, segment) = 1),
c{k} AS (SELECT a.host, a.template, a.segment, count(*) AS both_have, sum({x('a.n')} + {x('b.n')} - {x('(a.n + b.n)')}) AS s
         FROM k{k} a JOIN f{k} f ON f.host = a.host AND f.template = a.template
         JOIN k{k} b ON b.host = a.host AND b.template = a.template AND b.segment = f.leader AND b.kind = a.kind GROUP BY ALL),
g{k} AS (SELECT e.host, e.template, e.segment, leader_kinds + kinds - coalesce(both_have, 0) - 1 AS freedom,
                2 * (coalesce(s, 0) - {x('n')} - {x('leader_n')} + {x('(n + leader_n)')}) AS g
         FROM e{k} e JOIN f{k} USING (host, template) LEFT JOIN c{k} USING (host, template, segment)),
m{k} AS (SELECT *, CASE WHEN freedom = 0 OR g <= {critical_sql('nullif(freedom, 0)')} THEN '' ELSE segment END AS mark FROM g{k}),
b{k} AS (SELECT host, template, segment, string_agg(segment, '+') OVER (PARTITION BY host, template, mark ORDER BY segment
                ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS branch FROM m{k}),
t{k + 1} AS (SELECT * FROM t{k} WHERE done UNION ALL BY NAME
    SELECT s.* EXCLUDE (template, segment, kind, total, done), template || '/' || CASE WHEN total < {MIN_URLS} THEN '**' ELSE coalesce(branch, '*') END AS template,
           total < {MIN_URLS} OR len(segments) = {k + 1} AS done
    FROM s{k} s LEFT JOIN b{k} USING (host, template, segment))""")
    return "WITH " + ",".join(steps) + f""",
p AS (SELECT *, {smooth('OVER (PARTITION BY host, template)', 'host_purity')} AS purity,
             count(label) OVER (PARTITION BY host, template) AS labels FROM t{CHECKED_LEVELS})
SELECT page_id, host, path, rule,
       coalesce(label, CASE WHEN purity >= {REJECT} AND labels >= {MIN_LABELS} THEN 'block' ELSE 'allow' END) AS verdict,
       template, round(purity, 6) AS purity FROM p
"""

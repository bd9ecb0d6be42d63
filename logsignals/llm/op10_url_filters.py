"""URL filters by a path-template tree per host, with labelled purity.

Rules decide first (the longest that fits wins). They also label urls, so that templates learn from them;
a table of labels may be given instead. Paths are split into segments and a tree grows from each host, one
level at a time until the longest path ends: a segment that looks variable (digits, long hexadecimal, digits within) becomes a
wildcard by its shape; so do the branches of little weight of an open node, one whose branches keep coming as urls do (OPEN of
them at least are new); and the labelled branches of a node whose share of bad urls isn't
statistically apart from the node's own are merged into one. A template is rejected if its smoothed
share of bad urls, drawn towards its host's and that towards the prior, is over a half. The prior is at most a half, so a host of which nothing is known is allowed.

Every level works on the distinct paths that go on, and is written before the next; sums by node are made before they meet, so the joins
have tables on both sides and Spark can split a hot node.

A null url, or one without ``://``, has an empty host and path and is judged as those of the empty host; very long paths only take more
levels; repeated urls count each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logsignals.llm.textual import LOWER, UPPER, saved, table

#: The contract's rules: (host and path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Branches a url of an open node, times the mean weight that makes a branch of it stand alone, z of "apart", and weight of the prior.
OPEN, HEAVY, APART, WEIGHT = 0.1, 3.0, 1.96, 4.0
#: Levels that the SQL has; the tree itself has as many as the longest path.
SQL_LEVELS = 6
#: Patterns of variable segments and the wildcard for each, first that fits.
SHAPES = (("^[0-9]+$", "{n}"), ("^[0-9]+[.][a-z]+$", "{n.ext}"), ("^[0-9a-fA-F-]{16,}$", "{hex}"), ("[0-9].*[0-9].*[0-9]", "{mixed}"), ("^.{40,}$", "{long}"))


def _rule_sql(host: str = "host", path: str = "path", rules: Sequence[tuple[str, str]] = RULES, what: int = 0) -> str:
    """CASE over the rules, longest first: the rule (what = 0) or its verdict (1)."""
    whens = []
    for rule in sorted(rules, key=lambda r: -len(r[0])):
        name, _, rest = rule[0].partition("/")
        whens.append(f"WHEN ({host} = '{name}' OR right({host}, {len(name) + 1}) = '.{name}') AND left({path}, {len(rest) + 1}) = '/{rest}' THEN '{rule[what]}'")
    return f"CASE {' '.join(whens)} END"


def parsed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    part = lambda n: F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", n)
    return pages.withColumns({"host": F.translate(part(1), UPPER, LOWER), "path": part(2)})


def _shape(s: Column) -> Column:
    out = s
    for pattern, name in reversed(SHAPES):
        out = F.when(s.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def _level(tree: DataFrame) -> DataFrame:
    """The branch that each (host, prefix, seg) of tree takes."""
    own = saved(tree.groupBy("host", "prefix", "seg").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")))
    node = own.groupBy("host", "prefix").agg(F.count("*").alias("branches"), F.sum("n").alias("all"), F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
    both = own.join(saved(node), ["host", "prefix"])
    share = F.col("all_bad") / F.col("all_labelled")
    apart = F.abs(F.col("bad") / F.col("labelled") - share) > APART * F.sqrt(share * (1 - share) / F.col("labelled"))
    open_ = (F.col("branches") > 2) & (F.col("branches") >= OPEN * F.col("all"))
    named = (
        F.when(F.col("seg").startswith("{"), F.col("seg"))
        .when(open_ & (F.col("n") * F.col("branches") <= HEAVY * F.col("all")), F.lit("{rare}"))
        .when((F.col("labelled") > 0) & ~apart, F.lit("{like}"))
        .otherwise(F.col("seg"))
    )
    return both.select("host", "prefix", "seg", named.alias("branch"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity (smoothed share of bad urls of the template)."""
    urls = parsed(pages.select("page_id", "url"))
    urls = urls.withColumns({"rule": F.expr(_rule_sql(rules=rules)), "ruled": F.expr(_rule_sql(rules=rules, what=1))})
    tree = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad"))
    on = saved(tree.withColumns({"segs": F.filter(F.split("path", "/"), lambda s: s != ""), "prefix": F.lit("")}))
    done, depth = [on.filter(F.size("segs") == 0)], 0
    while not (on := saved(on.filter(F.size("segs") > depth).withColumn("seg", _shape(F.get("segs", F.lit(depth)))))).isEmpty():
        branch = saved(_level(on))
        on = saved(on.join(branch, ["host", "prefix", "seg"]).withColumn("prefix", F.concat("prefix", F.lit("/"), "branch")).drop("seg", "branch"))
        depth += 1
        done.append(on.filter(F.size("segs") == depth))
    tree = done[0]
    for part in done[1:]:
        tree = tree.unionByName(part)
    tree = saved(tree)

    totals = lambda *keys: tree.groupBy(*keys).agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    bad, labelled = totals().select(F.coalesce("b", F.lit(0)), F.coalesce("l", F.lit(0))).first()
    prior = min(0.5, (bad + 1) / (labelled + 2))
    hosts = totals("host").select("host", ((F.col("b") + WEIGHT * F.lit(prior)) / (F.col("l") + WEIGHT)).alias("of_host"))
    templates = saved(totals("host", "prefix")).join(saved(hosts), "host").select("host", "prefix", ((F.col("b") + WEIGHT * F.col("of_host")) / (F.col("l") + WEIGHT)).alias("purity"))
    learnt = tree.join(saved(templates), ["host", "prefix"]).select("host", "path", F.col("prefix").alias("template"), "purity")
    verdict = F.coalesce("ruled", F.when(F.col("purity") > 0.5, "block").otherwise("allow"))
    return urls.join(saved(learnt), ["host", "path"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"))


def _sql() -> str:
    shape = lambda s: "CASE " + " ".join(f"WHEN regexp_matches({s}, '{p}') THEN '{n}'" for p, n in SHAPES) + f" ELSE {s} END"
    steps = []
    for d in range(SQL_LEVELS):
        steps.append(f"""
a{d} AS MATERIALIZED (SELECT *, {shape(f'segs[{d + 1}]')} AS seg FROM t{d} WHERE len(segs) > {d}),
o{d} AS (SELECT *, count(*) OVER w AS branches, sum(n) OVER w AS total, sum(labelled) OVER w AS l, sum(bad) OVER w AS b FROM (SELECT host, prefix, seg, sum(n) AS n, sum(labelled)::DOUBLE AS labelled, sum(bad)::DOUBLE AS bad FROM a{d} GROUP BY ALL) WINDOW w AS (PARTITION BY host, prefix)),
b{d} AS MATERIALIZED (SELECT host, prefix, seg, CASE WHEN seg LIKE '{{%' THEN seg WHEN branches > 2 AND branches >= {OPEN}::DOUBLE * total AND n * branches <= {HEAVY}::DOUBLE * total THEN '{{rare}}'
  WHEN labelled > 0 THEN CASE WHEN abs(bad / labelled - b / l) > {APART}::DOUBLE * sqrt(b / l * (1 - b / l) / labelled) THEN seg ELSE '{{like}}' END ELSE seg END AS branch FROM o{d}),
t{d + 1} AS MATERIALIZED (SELECT host, path, n, labelled, bad, segs, prefix || '/' || branch AS prefix FROM a{d} JOIN b{d} USING (host, prefix, seg) UNION ALL SELECT * FROM t{d} WHERE len(segs) <= {d})""")
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
r AS (SELECT *, {_rule_sql()} AS rule, {_rule_sql(what=1)} AS ruled FROM u),
t0 AS MATERIALIZED (SELECT host, path, count(*) AS n, count(ruled) AS labelled, count(CASE WHEN ruled = 'block' THEN 1 END) AS bad, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs, '' AS prefix FROM r GROUP BY host, path),{','.join(steps)},
t AS (SELECT host, path, labelled, bad, prefix FROM t{SQL_LEVELS}),
pr AS (SELECT least(0.5::DOUBLE, (coalesce(sum(bad), 0) + 1)::DOUBLE / (coalesce(sum(labelled), 0) + 2)::DOUBLE) AS prior FROM t),
h AS (SELECT host, (sum(bad)::DOUBLE + {WEIGHT}::DOUBLE * max(prior)) / (sum(labelled)::DOUBLE + {WEIGHT}::DOUBLE) AS of_host FROM t, pr GROUP BY host),
p AS (SELECT host, prefix, (sum(bad)::DOUBLE + {WEIGHT}::DOUBLE * max(of_host)) / (sum(labelled)::DOUBLE + {WEIGHT}::DOUBLE) AS purity FROM t JOIN h USING (host) GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN purity > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, prefix AS template, purity FROM r JOIN t USING (host, path) JOIN p USING (host, prefix)
"""


SQL = _sql()

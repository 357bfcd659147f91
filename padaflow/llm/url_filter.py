"""URL filters by a path-template tree, in DataFrame operations only.

Pages that a rule decides are the labels.  Level by level, to the end of every path, a segment with a digit
becomes a wildcard, and so do all named children of a node (host, template so far) that has many of them,
each seen in about one path; children whose labelled block shares don't differ from the node's (two-sided z
test) are merged into one branch.  A node of one path is finished at once.

A template's purity is its labelled block share, smoothed by that of the node above, and so on to the host,
whose own is smoothed by the share of paths of the same shape (the template without merging) on all hosts,
and that by the share of all labelled pages: (blocked + weight * purity above) / (labelled + weight).  So a
branch without labels is judged by its siblings, and a host without labels by like paths elsewhere.  A
template is rejected if its purity reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padaflow.llm.common import Scratch, hot_join

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A node with so many named children, seen in under two paths each on average, is a wildcard.
CHILDREN = 8
Z2, WEIGHT, PURITY = 3.84, 4.0, 0.7
NODE = ["host", "template"]


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: after the first ``://`` up to /, ?, # or the end, A-Z lower-cased; then up to ?, # or the end."""
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit("")), UPPER, UPPER.lower()), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def fitting(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule (host + path) and its verdict; null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def token(segments: Column, level: Column) -> Column:
    """The segment of a level: $ after the last one, * if it holds a digit, else = and its text."""
    own = F.get(segments, level)
    return F.when(F.size(segments) <= level, "$").when(own.rlike("[0-9]"), "*").otherwise(F.concat(F.lit("="), own))


def _branches(active: DataFrame, scratch: Scratch, d: int, children: int, z2: float) -> DataFrame:
    """What each (host, template, token) of the active paths becomes, with the counts of its node."""
    child = active.groupBy(*NODE, "token").agg(F.count("*").alias("paths"), F.sum("blocked").cast("double").alias("x"), F.sum("labelled").cast("double").alias("m"))
    child = scratch.table(child, f"child{d}")
    named = F.sum(F.col("token").startswith("=").cast("bigint"))
    node = child.groupBy(*NODE).agg(F.count("*").alias("kids"), named.alias("named"), F.sum("paths").alias("all_paths"), F.sum("x").alias("b"), F.sum("m").alias("l"))
    node = scratch.table(node, f"node{d}")
    rows = hot_join(child, node, NODE, "kids", child.count())
    gap = F.col("x") * F.col("l") - F.col("b") * F.col("m")
    alike = (F.col("kids") > 1) & (F.col("token") != "$") & (F.col("m") > 0) & (gap * gap <= F.lit(z2) * F.col("m") * F.col("b") * (F.col("l") - F.col("b")))
    wild = F.col("token").startswith("=") & (F.col("named") >= children) & (F.col("all_paths") < 2 * F.col("kids"))
    general = F.when(wild, "*").otherwise(F.col("token"))
    return scratch.table(rows.select(*NODE, "token", F.when(alike, "~").otherwise(general).alias("branch"), general.alias("general"), "paths", "kids", "all_paths", "b", "l"), f"branch{d}")


def _below(weight: float, b: Column, n: Column) -> tuple[Column, Column]:
    """Purity is alpha + beta * (purity of the shape); the step to a node with these counts."""
    return (b + F.lit(weight) * F.col("alpha")) / (n + F.lit(weight)), F.lit(weight) * F.col("beta") / (n + F.lit(weight))


def templates(paths: DataFrame, scratch: Scratch, children: int, z2: float, weight: float) -> DataFrame:
    """``paths(host, path, blocked, labelled)`` with template, shape, alpha and beta, the last two down to the node above the template's end."""
    segments = F.split(F.regexp_replace("path", "^/", ""), "/")
    active = paths.withColumns({"segments": segments, "template": F.lit(""), "shape": F.lit(""), "alpha": F.lit(0.0), "beta": F.lit(1.0)})
    columns = [*paths.columns, "template", "shape", "alpha", "beta"]
    done, d = None, 0
    while True:
        active = scratch.table(active.withColumn("token", token(F.col("segments"), F.lit(d))), f"active{d}")
        n = active.count()
        if done is not None and not n:
            return done
        rows = hot_join(active, _branches(active, scratch, d, children, z2), [*NODE, "token"], "paths", n)
        alpha, beta = _below(weight, F.col("b"), F.col("l"))
        rows = rows.withColumns({"alpha": F.when(F.col("kids") > 1, alpha).otherwise(F.col("alpha")), "beta": F.when(F.col("kids") > 1, beta).otherwise(F.col("beta"))})
        rest = F.transform(F.sequence(F.lit(d + 1), F.greatest(F.lit(d + 1), F.size("segments"))), lambda i: token(F.col("segments"), i))
        rest = F.when((F.col("all_paths") == 1) & (F.col("token") != "$"), F.concat(F.lit("/"), F.array_join(rest, "/"))).otherwise("")
        rows = rows.withColumns({"template": F.concat("template", F.lit("/"), "branch", rest), "shape": F.concat("shape", F.lit("/"), "general", rest), "ended": (F.col("token") == "$") | (F.col("all_paths") == 1)})
        rows = scratch.table(rows.select(*columns, "segments", "ended"), f"level{d}")
        ended = rows.where("ended").select(columns)
        done = ended if done is None else done.union(ended)
        active, d = rows.where("NOT ended").drop("ended"), d + 1


def url_filter(pages: DataFrame, scratch: Scratch, rules: tuple[tuple[str, str, str], ...] = RULES, children: int = CHILDREN, z2: float = Z2, weight: float = WEIGHT, purity: float = PURITY) -> DataFrame:
    """One row per row of ``pages(page_id, url)``: page_id, host, path, rule, verdict, template.

    The longest fitting rule decides; without one, the template does.  A null url, or one without
    ``://``, has an empty host and path and is judged by the template of those.  Repeated and null
    page_ids are judged row by row; other columns are ignored; an empty table gives no rows.
    """
    host, path = parts(F.col("url"))
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "ruled": verdict})
    blocked = F.coalesce(F.sum((F.col("ruled") == "block").cast("bigint")), F.lit(0)).cast("double")
    paths = seen.groupBy("host", "path").agg(F.count("*").alias("n"), blocked.alias("blocked"), F.count("ruled").cast("double").alias("labelled"))
    paths = scratch.table(paths, "paths")
    sums = paths.agg(F.sum("blocked"), F.sum("labelled"), F.sum("n"), F.count("*")).first()
    prior = ((sums[0] or 0.0) + 1.0) / ((sums[1] or 0.0) + 2.0)
    ended = scratch.table(templates(paths, scratch, children, z2, weight), "ended")
    leaf = ended.groupBy(*NODE, "shape", "alpha", "beta").agg(F.count("*").alias("paths"), F.sum("blocked").alias("b"), F.sum("labelled").alias("l"))
    leaf = scratch.table(leaf, "leaf")
    shapes = leaf.groupBy("shape").agg(F.count("*").alias("uses"), ((F.sum("b") + F.lit(weight * prior)) / (F.sum("l") + F.lit(weight))).alias("like"))
    shapes = scratch.table(shapes, "shapes")
    ends = leaf.groupBy(*NODE).agg(F.count("*").alias("uses"), F.sum("b").alias("leaf_b"), F.sum("l").alias("leaf_l"))
    ends = scratch.table(ends, "ends")
    judged = hot_join(leaf, shapes, ["shape"], "uses", leaf.count()).drop("uses")
    judged = hot_join(scratch.table(judged, "liked"), ends, NODE, "uses", leaf.count())
    alpha, beta = _below(weight, F.col("leaf_b"), F.col("leaf_l"))
    judged = scratch.table(judged.select(*NODE, "shape", "paths", F.when(alpha + beta * F.col("like") >= purity, "block").otherwise("allow").alias("judged")), "judged")
    named = hot_join(ended.select("host", "path", "n", *NODE[1:], "shape"), judged, [*NODE, "shape"], "paths", sums[3]).select("host", "path", "n", "template", "judged")
    out = hot_join(seen, scratch.table(named, "named"), ["host", "path"], "n", sums[2] or 0)
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", "judged").alias("verdict"), "template")


def sql(levels: int = 12) -> str:
    """The query in DuckDB SQL, for paths of fewer segments than ``levels``."""
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    longest = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(kind, h + p)[k]}'" for kind, h, p in longest) + " END"
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    real = lambda x: f"CAST({x} AS DOUBLE)"
    w = real(WEIGHT)
    out = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{pattern}', 1), ''), '{UPPER}', '{UPPER.lower()}') AS host, coalesce(regexp_extract(url, '{pattern}', 2), '') AS path FROM pages),
seen AS (SELECT *, {case(1)} AS rule, {case(0)} AS ruled FROM u),
p0 AS MATERIALIZED (
  SELECT host, path, {real("coalesce(sum(CASE WHEN ruled = 'block' THEN 1 END), 0)")} AS blocked, {real("count(ruled)")} AS labelled,
    string_split(regexp_replace(path, '^/', ''), '/') AS segments, '' AS template, '' AS shape, {real(0)} AS alpha, {real(1)} AS beta, false AS ended FROM seen GROUP BY host, path)"""
    for d in range(levels):
        own = f"segments[{d + 1}]"
        out += f""",
s{d} AS MATERIALIZED (SELECT *, CASE WHEN len(segments) <= {d} THEN '$' WHEN regexp_matches({own}, '[0-9]') THEN '*' ELSE '=' || {own} END AS token FROM p{d} WHERE NOT ended),
c{d} AS MATERIALIZED (SELECT host, template, token, count(*) AS paths, sum(blocked) AS x, sum(labelled) AS m FROM s{d} GROUP BY host, template, token),
n{d} AS MATERIALIZED (SELECT host, template, count(*) AS kids, count(*) FILTER (starts_with(token, '=')) AS named, sum(paths) AS all_paths, sum(x) AS b, sum(m) AS l FROM c{d} GROUP BY host, template),
b{d} AS MATERIALIZED (
  SELECT host, template, token, kids, b, l, CASE WHEN starts_with(token, '=') AND named >= {CHILDREN} AND all_paths < 2 * kids THEN '*' ELSE token END AS general,
    kids > 1 AND token != '$' AND m > 0 AND (x * l - b * m) * (x * l - b * m) <= {real(Z2)} * m * b * (l - b) AS alike FROM c{d} JOIN n{d} USING (host, template)),
p{d + 1} AS MATERIALIZED (
  SELECT host, path, blocked, labelled, segments, template || '/' || CASE WHEN alike THEN '~' ELSE general END AS template, shape || '/' || general AS shape,
    CASE WHEN kids > 1 THEN (b + {w} * alpha) / (l + {w}) ELSE alpha END AS alpha, CASE WHEN kids > 1 THEN {w} * beta / (l + {w}) ELSE beta END AS beta, token = '$' AS ended
  FROM s{d} JOIN b{d} USING (host, template, token))"""
    ends = " UNION ALL ".join(f"SELECT * FROM p{d} WHERE ended" for d in range(1, levels + 1))
    return (
        out
        + f""",
prior AS (SELECT (coalesce(sum(blocked), 0) + {real(1)}) / (coalesce(sum(labelled), 0) + {real(2)}) AS prior FROM p0),
e AS MATERIALIZED ({ends}),
shapes AS (SELECT shape, (sum(blocked) + {w} * any_value(prior)) / (sum(labelled) + {w}) AS likeness FROM e, prior GROUP BY shape),
leaf AS (SELECT host, template, sum(blocked) AS b, sum(labelled) AS l FROM e GROUP BY host, template),
judged AS (
  SELECT host, path, template, CASE WHEN (b + {w} * alpha) / (l + {w}) + {w} * beta / (l + {w}) * likeness >= {real(PURITY)} THEN 'block' ELSE 'allow' END AS judged
  FROM e JOIN leaf USING (host, template) JOIN shapes USING (shape))
SELECT page_id, host, path, rule, coalesce(ruled, judged) AS verdict, template FROM seen JOIN judged USING (host, path)
"""
    )

"""URL filter: listed rules first, then a path-template tree per host.

Paths are read segment by segment. Runs of digits become ``{n}``. At each node of a host's tree, segments with too few pages to be
judged by themselves become ``*``, and siblings whose labelled share of bad pages doesn't differ significantly become one branch
(``de|en``). A template is rejected when its smoothed share of bad labelled pages is high enough:
``(bad + strength * overall share) / (labelled + strength)``.

Every tree has ``DEPTH`` levels. Below them a branch is followed, level by level to the ends of its paths, as long as a verdict can depend on it:
while it has ``LEAST`` labelled pages that don't all carry the same label, or pages without one. What lies deeper is ``**``. Counting is by shape of path, so a popular host is summed
up map-side. A node has a branch for every segment with ``LEAST`` pages, whatever its share; siblings are merged by their
distinct shares of bad pages, and a template names at most ``RARE`` large segments of a merged branch and the first small one (``a|*``).

Defined results: a url that is null or has no ``://`` has empty host and path; rows without a label count as pages only; a
template without enough labelled pages is allowed; repeated rows count as often as they occur and get the same
verdict; a null id is passed on; other columns are never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajspark.session import materialize

DEPTH = 4          # levels that every branch has; below, only branches that can change a verdict go on
RARE = 50          # a segment with less than 1/50 of its node's pages isn't named in a branch that holds several such
LEAST = 5          # a segment with fewer pages than this is variable; also the labelled pages that a rejection needs
DISTANCE = 1.36    # sqrt(ln(2 / 0.05) / 2): Hoeffding bound at 5 %
STRENGTH = 4.0     # pages' worth of the overall share in each template
REJECT = 0.8

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a url column."""
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(F.col(url), mark + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def first_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits columns host and path (null: none)."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(str(r))):
        host = (F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")
        fits = host & F.col("path").startswith(rule.path)
        text = F.when(fits, F.lit(str(rule))).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def shape(path: str = "path") -> Column:
    """A path with ``{n}`` for digits; ``*`` and ``|`` in it are escaped, since templates use them (``%2A`` of a path reads ``%{n}A``)."""
    plain = F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "{n}")
    return F.replace(F.replace(plain, F.lit("*"), F.lit("%2A")), F.lit("|"), F.lit("%7C"))


def path_templates(pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The tree of each host: a row per (host, shape) with its template, and the template's pages, labelled and bad.

    ``pages`` has host, path and bad (1, 0, or null without a label).
    """
    shapes = materialize(
        pages.groupBy("host", shape().alias("shape")).agg(
            F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")
        ).withColumn("prefix", F.lit("")),
        "shapes",
    )
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    node = ["host", "prefix"]
    length, level, done = F.size(F.split("shape", "/")), 0, []
    while True:
        if level >= depth:
            one_label = (F.col("n") == F.col("labelled")) & F.col("bad").isin(0, F.col("labelled"))
            live = shapes.groupBy(*node).agg(*sums, F.max(length).alias("longest")).where(
                (F.col("longest") > level) & (F.col("labelled") >= LEAST) & ~one_label
            ).select(*node, F.lit(True).alias("live"))
            shapes = materialize(shapes.join(live, node, "left"), f"live-{level}")
            deeper = F.when(length > level, "/**").otherwise("")
            done.append(shapes.where("live IS NULL").withColumn("template", F.concat("prefix", deeper)).drop("live", "prefix"))
            shapes = shapes.where("live").drop("live")
            if shapes.isEmpty():
                break
        segment = F.coalesce(F.get(F.split("shape", "/"), F.lit(level)), F.lit(""))
        rows = shapes.withColumn("segment", segment)
        children = rows.groupBy(*node, "segment").agg(*sums)
        totals = children.groupBy(*node).agg(F.sum("n").alias("pages"))
        variable = F.col("n") < LEAST
        named = children.join(totals, node).withColumn("branch", F.when(variable, "*").otherwise(F.col("segment")))
        rare = ~variable & (F.col("n") * RARE < F.col("pages"))
        branches = named.groupBy(*node, "branch").agg(*sums, F.max(rare).alias("rare"))
        merged = named.join(_merge(branches), [*node, "branch"]).select(*node, "segment", "label")
        shapes = materialize(
            rows.join(merged, [*node, "segment"]).select(
                "host", "shape", "n", "labelled", "bad", F.concat("prefix", F.lit("/"), "label").alias("prefix")
            ),
            f"tree-{level}",
        )
        level += 1
    named = reduce(DataFrame.unionByName, done)
    stats = named.groupBy("host", "template").agg(*sums)
    return named.select("host", "shape", "template").join(stats, ["host", "template"])


def _merge(branches: DataFrame) -> DataFrame:
    """Siblings in order of their share of bad pages, cut wherever two neighbours differ significantly.

    Siblings with equal shares are never cut, so only the distinct shares of a node are put in order, each with the
    labelled pages of its first and last sibling. Siblings without enough labels are alike among themselves only.
    """
    enough, share = F.col("labelled") >= LEAST, F.col("bad") / F.col("labelled")
    ranked = branches.withColumn("enough", enough).withColumn("share", F.when(enough, share).otherwise(-1.0))
    keys = ["host", "prefix", "enough", "share"]
    shares = ranked.groupBy(*keys).agg(
        F.min(F.struct("branch", "labelled"))["labelled"].alias("first"), F.max(F.struct("branch", "labelled"))["labelled"].alias("last")
    )
    order = Window.partitionBy("host", "prefix").orderBy(F.col("enough").desc(), "share")
    apart = F.abs(F.col("share") - F.lag("share").over(order))
    bound = DISTANCE * (1 / F.sqrt("first") + 1 / F.sqrt(F.lag("last").over(order)))
    cut = (F.col("enough") != F.lag("enough").over(order)) | (F.col("enough") & (apart > bound))
    runs = shares.withColumn("cut", F.when(cut, 1).otherwise(0)).withColumn("run", F.sum("cut").over(order)).select(*keys, "run")
    run = ranked.join(runs, keys)
    few = F.when(F.col("rare"), F.col("branch"))
    labels = run.groupBy("host", "prefix", "run").agg(
        F.collect_list(F.when(~F.col("rare"), F.col("branch"))).alias("large"), F.min(few).alias("small"), F.count(few).alias("smalls")
    )
    # Small segments of one branch may be any number; the first stands for them.
    rest = F.when(F.col("smalls") > 0, F.array("small")).otherwise(F.array().cast("array<string>"))
    listed = F.array_join(F.sort_array(F.concat("large", rest)), "|")
    label = F.when(F.col("smalls") > 1, F.concat(listed, F.lit("|*"))).otherwise(listed)
    return run.join(labels.select("host", "prefix", "run", label.alias("label")), ["host", "prefix", "run"]).select(
        "host", "prefix", "branch", "label"
    )


def judge(pages: DataFrame, rules: list[Rule], depth: int = DEPTH) -> DataFrame:
    """page_id, host, path, rule, verdict, template of each row of ``pages`` (page_id, url).

    Pages under a rule are the labelled ones: the tree carries the rules' verdicts over to like paths of a host.
    """
    host, path = split_url("url")
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = first_rule(rules)
    ruled = parsed.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), shape().alias("shape"))
    labelled = ruled.withColumn("bad", F.when(F.col("ruled") == BLOCK, 1).when(F.col("ruled") == ALLOW, 0))
    trees = materialize(path_templates(labelled, depth), "templates")
    overall = trees.select("host", "template", "labelled", "bad").distinct().agg(
        F.coalesce(F.sum("bad") / F.sum("labelled"), F.lit(0.0))
    ).first()[0]
    purity = (F.col("bad") + STRENGTH * overall) / (F.col("labelled") + STRENGTH)
    judged = trees.select(
        "host", "shape", "template",
        F.when((F.col("labelled") >= LEAST) & (purity >= REJECT), BLOCK).otherwise(ALLOW).alias("learned"),
    )
    return ruled.join(judged, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "learned").alias("verdict"), "template"
    )


def judge_sql(rules: list[Rule], depth: int = DEPTH, levels: int = 8) -> str:
    """The same in SQL, one block per level. It states ``levels`` levels, where the code goes on as far as it has to."""
    by_length = sorted(rules, key=lambda r: -len(str(r)))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r}'" for r in by_length)
    verdict = " ".join(f"WHEN {fits(r)} THEN '{r.verdict}'" for r in by_length)
    parts = [f"""rests AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parsed AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests
    ), ruled AS MATERIALIZED (
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS ruled,
               replace(replace(regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', '{{n}}', 'g'), '*', '%2A'), '|', '%7C') AS shape
        FROM parsed
    ), tree0 AS MATERIALIZED (
        SELECT host, shape, '' AS prefix, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = '{BLOCK}') AS bad,
               len(string_split(shape, '/')) AS segments, 0 AS taken FROM ruled GROUP BY host, shape
    )"""]
    for k in range(levels):
        live = "true" if k < depth else f"""max(segments) OVER node > {k} AND taken = {k} AND sum(labelled) OVER node >= {LEAST}
               AND NOT (sum(n) OVER node = sum(labelled) OVER node AND sum(bad) OVER node IN (0, sum(labelled) OVER node))"""
        parts.append(f"""rows{k} AS MATERIALIZED (
        SELECT *, {live} AS live, coalesce(string_split(shape, '/')[{k + 1}], '') AS segment
        FROM tree{k} WINDOW node AS (PARTITION BY host, prefix, taken)
    ), children{k} AS (
        SELECT host, prefix, segment, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad FROM rows{k} WHERE live GROUP BY ALL
    ), named{k} AS MATERIALIZED (
        SELECT *, CASE WHEN n < {LEAST} THEN '*' ELSE segment END AS branch,
               n >= {LEAST} AND n * {RARE} < sum(n) OVER (PARTITION BY host, prefix) AS rare FROM children{k}
    ), branches{k} AS MATERIALIZED (
        SELECT host, prefix, branch, sum(labelled) AS labelled, sum(labelled) >= {LEAST} AS enough, bool_or(rare) AS rare,
               CASE WHEN sum(labelled) >= {LEAST} THEN sum(bad) / sum(labelled) ELSE -1 END AS share FROM named{k} GROUP BY host, prefix, branch
    ), shares{k} AS (
        SELECT host, prefix, enough, share, arg_min(labelled, branch) AS first, arg_max(labelled, branch) AS last
        FROM branches{k} GROUP BY ALL
    ), cuts{k} AS (
        SELECT *, CASE WHEN enough <> lag(enough) OVER o OR enough AND abs(share - lag(share) OVER o)
                    > {DISTANCE} * (1 / sqrt(first) + 1 / sqrt(lag(last) OVER o)) THEN 1 ELSE 0 END AS cut
        FROM shares{k} WINDOW o AS (PARTITION BY host, prefix ORDER BY enough DESC, share)
    ), runs{k} AS MATERIALIZED (
        SELECT b.host, b.prefix, branch, rare, run FROM branches{k} b JOIN (
            SELECT *, sum(cut) OVER (PARTITION BY host, prefix ORDER BY enough DESC, share) AS run FROM cuts{k}
        ) USING (host, prefix, enough, share)
    ), smalls{k} AS (
        SELECT host, prefix, run, min(branch) FILTER (rare) AS small, count(*) FILTER (rare) AS smalls FROM runs{k} GROUP BY ALL
    ), labels{k} AS (
        SELECT host, prefix, run, string_agg(branch, '|' ORDER BY branch) FILTER (NOT rare OR branch = small)
               || CASE WHEN max(smalls) > 1 THEN '|*' ELSE '' END AS label
        FROM runs{k} JOIN smalls{k} USING (host, prefix, run) GROUP BY host, prefix, run
    ), tree{k + 1} AS MATERIALIZED (
        SELECT r.host, r.shape, r.prefix || '/' || label AS prefix, r.n, r.labelled, r.bad, r.segments, {k + 1} AS taken
        FROM rows{k} r JOIN named{k} USING (host, prefix, segment) JOIN runs{k} USING (host, prefix, branch)
        JOIN labels{k} USING (host, prefix, run) WHERE r.live
        UNION ALL SELECT host, shape, prefix, n, labelled, bad, segments, taken FROM rows{k} WHERE NOT live
    )""")
    parts.append(f"""templates AS MATERIALIZED (
        SELECT *, prefix || CASE WHEN segments > taken THEN '/**' ELSE '' END AS template FROM tree{levels}
    ), overall AS (
        SELECT coalesce(sum(bad) / nullif(sum(labelled), 0), 0) AS prior FROM templates
    ), judged AS (
        SELECT host, shape, template, sum(labelled) OVER t AS labelled, sum(bad) OVER t AS bad
        FROM templates WINDOW t AS (PARTITION BY host, template)
    )""")
    return f"""WITH {', '.join(parts)}
    SELECT page_id, host, path, rule, template,
           coalesce(ruled, CASE WHEN labelled >= {LEAST} AND (bad + {STRENGTH} * prior) / (labelled + {STRENGTH}) >= {REJECT}
                           THEN '{BLOCK}' ELSE '{ALLOW}' END) AS verdict
    FROM ruled JOIN judged USING (host, shape) CROSS JOIN overall"""

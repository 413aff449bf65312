"""URL filter by a path-template tree with labelled purity.

Every host has a tree of path templates, one level per segment, as deep as its paths.
Segments with a digit, and the children of a node with many children of few pages
each, are generalised to a wildcard. Then branches merge level by level up the tree:
a node whose labelled pages are as often bad as its parent's, within ``Z`` standard
errors, becomes part of its parent; the children of one node that are significantly
worse, or better, become one branch. A branch is judged by the share of bad pages among the
labelled ones left in it, smoothed towards its host, and the host towards all pages;
it is blocked from ``REJECT`` on. Rules come first: the longest one that fits decides.

All of it is grouping and joining in Spark. Paths are counted once per distinct pattern
before the tree is built, so a large host is small by then. Each round walks from one
fork of the tree to the next: what all patterns below a node begin with is passed in
one step, and patterns fewer than could fill a wildcard are done. So rounds follow the
nesting of forks, not the length of the paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.llm.common import checkpointed, small_side

MANY = 8  # children from which a node may be generalised ...
FEW = 3.0  # ... if they have fewer pages each
Z = 1.96
SMOOTHING = 10.0
REJECT = 0.5
WILD = "*"

# Fixed values: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path) as written, the host's A-Z lower-cased; empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return (
        F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit("")),
        F.coalesce(path, F.lit("")),
    )


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule for the host or a parent domain, else nulls."""
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    name = verdict = F.lit(None).cast("string")
    for domain, prefix, decision in reversed(ordered):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(prefix)
        name = F.when(fits, domain + prefix).otherwise(name)
        verdict = F.when(fits, decision).otherwise(verdict)
    return name, verdict


def path_shape(path: Column) -> Column:
    """All segments, those with a digit as wildcards."""
    return F.transform(
        F.filter(F.split(path, "/"), lambda s: s != ""),
        # What follows the last dot names a kind of page and stays.
        lambda s: F.when(
            s.rlike("[0-9]"), F.concat(F.lit(WILD), F.regexp_extract(s, r"\.[A-Za-z]+$", 0))
        ).otherwise(s),
    )


def _generalised(shapes: DataFrame) -> DataFrame:
    """Add ``template`` to rows of distinct (host, shape): wildcards for many rare children."""
    active = shapes.withColumns({"template": F.array().cast("array<string>"), "rest": F.col("shape")})
    done = None
    while True:
        active = checkpointed(active)
        # The first place where the least and the greatest of a node's patterns differ.
        differ = F.array_position(F.zip_with("least", "most", lambda a, b: a.eqNullSafe(b)), False)
        shared = (
            active.groupBy("host", "template")
            .agg(F.min("rest").alias("least"), F.max("rest").alias("most"), F.count("*").alias("shapes"))
            .select(
                "host",
                "template",
                F.when((F.col("shapes") >= MANY) & (differ > 0), (differ - 1).cast("int")).alias("shared"),
            )
        )
        step = F.coalesce("shared", F.size("rest"))
        moved = checkpointed(
            active.join(shared, ["host", "template"]).select(
                *shapes.columns,
                F.concat("template", F.slice("rest", 1, step)).alias("template"),
                F.slice("rest", step + 1, F.size("rest")).alias("rest"),
            )
        )
        ended = moved.filter(F.size("rest") == 0).drop("rest")
        done = ended if done is None else done.union(ended)
        going = moved.filter(F.size("rest") > 0).withColumn("child", F.get("rest", F.lit(0)))
        if going.isEmpty():
            return done
        variable = (
            going.groupBy("host", "template", "child")
            .agg(F.sum("pages").alias("pages"))
            .groupBy("host", "template")
            .agg(((F.count("*") >= MANY) & (F.sum("pages") < FEW * F.count("*"))).alias("variable"))
        )
        active = going.join(variable, ["host", "template"]).select(
            *shapes.columns,
            F.array_append("template", F.when(F.col("variable"), WILD).otherwise(F.col("child"))).alias("template"),
            F.slice("rest", 2, F.size("rest")).alias("rest"),
        )


def _share(bad: Column, labelled: Column, prior: Column) -> Column:
    return (bad + prior * SMOOTHING) / (labelled + SMOOTHING)


def _judged(tree: DataFrame) -> DataFrame:
    """Add ``bad_share`` to (host, shape, template, labelled, bad) rows."""
    sums = (F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    # A name for each node on the way to a template, the root's first.
    nodes = F.transform(
        F.sequence(F.lit(0), F.size("template")),
        lambda n: F.md5(F.array_join(F.slice("template", 1, n), "/")),
    )
    leaves = checkpointed(tree.groupBy("host", "template").agg(*sums).withColumn("nodes", nodes))
    overall = leaves.agg(
        F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("all_share")
    )
    # One row; a scalar, not a table.
    all_share = F.lit(float(overall.first()[0]))
    hosts = leaves.groupBy("host").agg(*sums).select(
        "host", _share(F.col("bad"), F.col("labelled"), all_share).alias("host_share")
    )
    totals = checkpointed(
        leaves.filter("labelled > 0")
        .select("host", "labelled", "bad", "nodes", F.posexplode("nodes").alias("depth", "node"))
        .groupBy("host", "node", F.get("nodes", F.col("depth") - 1).alias("parent"))
        .agg(*sums)
    )
    parents = totals.select(
        "host",
        F.col("node").alias("parent"),
        F.col("labelled").alias("p_labelled"),
        F.col("bad").alias("p_bad"),
    )
    rate = _share(F.col("p_bad"), F.col("p_labelled"), F.col("host_share"))
    error = F.sqrt(rate * (1 - rate) / F.col("labelled"))
    distance = F.coalesce(F.try_divide(F.col("bad") / F.col("labelled") - rate, error), F.lit(0.0))
    # Nodes that stay apart from their parent.
    apart = small_side(
        totals.join(parents, ["host", "parent"])
        .join(hosts, "host")
        .withColumn("side", F.when(distance > Z, 1).when(distance < -Z, -1).otherwise(0))
        .filter("side <> 0")
        .select("host", "node", F.struct("parent", "side").alias("branch"))
    )
    deepest = (
        leaves.select("host", "template", F.posexplode("nodes").alias("depth", "node"))
        .join(apart, ["host", "node"])
        .groupBy("host", "template")
        .agg(F.max_by("branch", "depth").alias("branch"))
    )
    root = F.struct(F.lit("").alias("parent"), F.lit(0).alias("side"))
    placed = checkpointed(
        leaves.drop("nodes")
        .join(deepest, ["host", "template"], "left")
        .withColumn("branch", F.coalesce("branch", root))
    )
    merged = (
        placed.groupBy("host", "branch")
        .agg(*sums)
        .join(hosts, "host")
        .select(
            "host",
            "branch",
            _share(F.col("bad"), F.col("labelled"), F.col("host_share")).alias("bad_share"),
        )
    )
    shares = placed.join(merged, ["host", "branch"]).select("host", "template", "bad_share")
    return tree.select("host", "shape", "template").join(shares, ["host", "template"])


def judge_urls(
    pages: DataFrame,
    labels: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    label_id: str = "doc_id",
    bad: str = "quality = 0 or toxic = 1",
    rules=RULES,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, bad_share) for every page.

    ``labels`` marks pages by id; ``bad`` is SQL over its columns, null counting as
    not bad, and a page with several labels is bad if one of them says so. A null
    url and one without ``://`` have empty host and path and are judged like any
    page of that host. Without any label nothing is blocked but by rules. Repeated
    rows count and are returned like others. Rows without id have no label. Paths of any
    depth and length are judged whole; templates that tie share a verdict only if they
    are in one branch. An empty table gives an empty result.
    """
    host, path = url_parts(F.col(url_col))
    marked = (
        labels.select(F.col(label_id).cast("long").alias("page_id"), F.expr(f"coalesce({bad}, false)").alias("bad"))
        .groupBy("page_id")
        .agg(F.max("bad").alias("bad"))
    )
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("shape", path_shape(F.col("path")))
    shapes = checkpointed(
        parsed.join(marked, "page_id", "left")
        .groupBy("host", "shape")
        .agg(
            F.count("*").alias("pages"),
            F.count("bad").alias("labelled"),
            F.sum(F.when(F.col("bad"), 1).otherwise(0)).alias("bad"),
        )
    )
    judged = _judged(_generalised(shapes))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return parsed.join(judged, ["host", "shape"]).select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("bad_share") >= REJECT, "block").otherwise("allow")).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("template", "/")).alias("template"),
        "bad_share",
    )

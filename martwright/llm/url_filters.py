"""URL filter by a tree of path templates.

A URL belongs to a host and a path of segments. Along the tree of a host's paths, from
the root on, a segment that identifies a page becomes a wildcard, and sibling branches that
are statistically alike are merged: a branch is compared with all its siblings together, by
a likelihood ratio (G) test on counts, once for the kinds of segments below it and once for
its labels. What is left are the host's templates.

A template is rejected if the share of bad pages among its labelled ones reaches a
threshold. The share is smoothed towards what the same path says elsewhere: first in the
tree of the parent domain, then in the tree of all paths whatever their host, where each
domain has one vote, then a prior. A host without labels is judged by these.

Hosts of any size are no trouble: pages are first counted by shape of path, with map-side
combine, for the host, the parent domain and all hosts at once, and the three trees are
walked over these counts. A step goes over a whole unbranched stretch, so there are as many
steps as branchings on a path, whatever the paths' length, and none is cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martwright.llm.shared import lower_ascii, saved

# The rules of the filter, as (host and path, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: Kinds of segments below a branch: none, four wildcards, literals in eleven groups.
KINDS = 16
#: A pair of samples differs if G passes the 99.9 % point of chi square (15 and 1 degrees of
#: freedom) and is this much per page of the smaller sample, so that size alone separates nothing.
KINDS_DIFFER, RATES_DIFFER, EFFECT = 37.7, 10.83, 0.1


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits; a rule fits its host and all subdomains, and every path
    that starts with its own. Null if none fits."""
    rule = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest ends up outermost
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
    return rule


def _shape(segment: Column) -> Column:
    """Segments that identify a page become wildcards at once; a file ending stays."""
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    return (
        F.when(stem.rlike("^[0-9]+$"), F.concat(F.lit("{n}"), ending))
        .when(stem.rlike("^[0-9a-fA-F-]{16,}$"), F.concat(F.lit("{id}"), ending))
        .when(stem.rlike("[0-9]") & (F.length(stem) > 8), F.concat(F.lit("{mixed}"), ending))
        .when(F.length(stem) > 64, F.concat(F.lit("{long}"), ending))
        .otherwise(segment)
    )


def _shapes(path: str) -> Column:
    """All segments as shapes. Of a run of equal shapes the first three stay: traps that
    repeat a segment without end share the shape of three."""
    shaped = F.transform(F.filter(F.split(F.col(path), "/"), lambda s: s != ""), _shape)
    return F.filter(
        F.transform(
            shaped,
            lambda s, i: F.when(
                (i < 3) | (F.get(shaped, i - 1) != s) | (F.get(shaped, i - 2) != s) | (F.get(shaped, i - 3) != s), s
            ),
        ),
        lambda s: s.isNotNull(),
    )


def _kind(segment: Column) -> Column:
    literal = F.pmod(F.xxhash64(segment), F.lit(KINDS - 5)).cast("int") + 5
    kind = F.when(segment.isNull(), 0)
    for k, name in enumerate(("{n}", "{id}", "{mixed}", "{long}"), 1):
        kind = kind.when(segment.startswith(name), k)
    return kind.otherwise(literal)


def _entropy(count: Column) -> Column:
    return F.when(count > 0, count * F.ln(count.cast("double"))).otherwise(F.lit(0.0))


_SUMS = ["n", "labelled", "bad"]


def _tested(branches: DataFrame, group: str) -> DataFrame:
    """`branches` with `kinds_differ` and `rates_differ`: whether a branch and the rest of its
    group, of which the sums have the prefix `group`, come from different distributions by
    the G test of two samples. An empty sample differs from none."""

    def cell(own: Column, total: Column) -> Column:
        return _entropy(own) + _entropy(total - own) - _entropy(total)

    def g(name: str, cells: Column) -> Column:
        own, total = F.col(name), F.col(f"{group}_{name}")
        return F.lit(2.0) * (cells - cell(own, total))

    def differs(value: str, name: str, at_least: float) -> Column:
        smaller = F.least(F.col(name), F.col(f"{group}_{name}") - F.col(name))
        return (F.col(value) > at_least) & (F.col(value) > 2 * EFFECT * smaller)

    kinds = F.aggregate(F.zip_with("kinds", f"{group}_kinds", cell), F.lit(0.0), lambda a, b: a + b)
    bad, worst = F.col("bad"), F.col(f"{group}_bad")
    rates = cell(bad, worst) + cell(F.col("labelled") - bad, F.col(f"{group}_labelled") - worst)
    # Columns of their own: Spark does not repeat an expression that is read more than once.
    measured = branches.withColumn("g_kinds", g("n", kinds)).withColumn("g_rates", g("labelled", rates))
    return measured.withColumn("kinds_differ", differs("g_kinds", "n", KINDS_DIFFER)).withColumn(
        "rates_differ", differs("g_rates", "labelled", RATES_DIFFER)
    )


def _summed(prefix: str) -> list[Column]:
    kinds = F.array(*[F.sum(F.get("kinds", F.lit(k))) for k in range(KINDS)])
    return [*[F.sum(c).alias(f"{prefix}_{c}") for c in _SUMS], kinds.alias(f"{prefix}_kinds")]


def _general(branches: DataFrame, vary: float, weight: float) -> DataFrame:
    """(scope, done, segment, general): the name under which a branch goes on.

    Branches that do not differ from their siblings taken together are one, `*`; without
    labels they are one of their own, `*?`, unless the values vary so much that they name
    pages. Those that differ, in labels to the worse or better or in what lies below, are
    tried once more among themselves and stay alone if they differ there too. One row per
    branch and joins by the node above it, which AQE can split.
    """
    node = ["scope", "done"]
    nodes = branches.groupBy(*node).agg(F.count(F.lit(1)).alias("siblings"), *_summed("node"))
    varied = F.col("siblings") > vary * F.col("node_n")
    worse = F.col("bad") / F.col("labelled") > F.col("node_bad") / F.col("node_labelled")
    first = (
        F.when(varied & (F.col("labelled") < weight), F.when(F.col("kinds_differ"), "*~").otherwise("*"))
        .when(F.col("labelled") == 0, F.when(F.col("kinds_differ"), "*?~").otherwise("*?"))
        .when(F.col("rates_differ"), F.when(worse, "*+").otherwise("*-"))
        .otherwise(F.when(F.col("kinds_differ"), "*~").otherwise("*"))
    )
    placed = _tested(branches.join(nodes, node), "node").select(*node, "segment", *_SUMS, "kinds", first.alias("class"))
    groups = placed.groupBy(*node, "class").agg(F.count(F.lit(1)).alias("members"), *_summed("group"))
    again = ~F.col("class").isin("*", "*?") & (F.col("kinds_differ") | F.col("rates_differ"))
    alone = (F.col("members") == 1) | again
    return _tested(placed.join(groups, [*node, "class"]), "group").select(
        *node, "segment", F.when(alone, F.col("segment")).otherwise(F.col("class")).alias("general")
    )


def _walk(counts: DataFrame, vary: float, weight: float) -> DataFrame:
    """(scope, shape, template, n, labelled, bad) from (scope, shape, n, labelled, bad)."""
    node = ["scope", "done"]
    rows = saved(counts.withColumn("done", F.array().cast("array<string>")).withColumn("rest", F.col("shape")))
    finished = []
    while True:
        finished.append(rows.where("size(rest) = 0"))
        going = rows.where("size(rest) > 0")
        if going.isEmpty():
            break
        # What all paths of a node begin with is what the least and the greatest share.
        ends = going.groupBy(*node).agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
        same = F.zip_with("low", "high", lambda a, b: a.eqNullSafe(b))
        differs_at = F.array_position(same, F.lit(False)).cast("int")
        shared = ends.select(*node, F.when(differs_at > 0, differs_at - 1).otherwise(F.size("low")).alias("shared"))
        ahead = going.join(shared, node).select(
            "scope",
            "shape",
            *_SUMS,
            F.concat("done", F.slice("rest", F.lit(1), F.col("shared"))).alias("done"),
            F.slice("rest", F.col("shared") + 1, F.size("rest")).alias("rest"),
        )
        ahead = ahead.withColumn("segment", F.get("rest", F.lit(0))).withColumn("kind", _kind(F.get("rest", F.lit(1))))
        branches = (
            ahead.where("segment is not null")
            .groupBy(*node, "segment", "kind")
            .agg(*[F.sum(c).alias(c) for c in _SUMS])
            .groupBy(*node, "segment")
            .agg(
                *[F.sum(c).alias(c) for c in _SUMS],
                F.array(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)) for k in range(KINDS)]).alias("kinds"),
            )
        )
        named = _general(branches, vary, weight)
        onward = F.when(F.col("general").isNull(), F.col("done")).otherwise(F.array_append("done", F.col("general")))
        rows = saved(
            ahead.join(named, [*node, "segment"], "left").select(
                "scope", "shape", *_SUMS, onward.alias("done"), F.slice("rest", F.lit(2), F.size("rest") + 1).alias("rest")
            )
        )
    every = reduce(DataFrame.unionByName, finished)
    return every.select("scope", "shape", F.concat(F.lit("/"), F.concat_ws("/", "done")).alias("template"), *_SUMS)


def templates(
    pages: DataFrame,
    vary: float = 0.5,
    prior: float = 0.1,
    weight: float = 4.0,
    votes: float = 2.0,
    reject_at: float = 0.5,
) -> DataFrame:
    """(host, shape, template, n, labelled, bad, purity, rejected) from (host, path, bad).

    `bad` is 1, 0 or null for a page without a label. Where siblings have more than `vary`
    distinct values per page, the values name pages: those with fewer than `weight` labels
    have no rate of their own. Purity is (bad + weight * p) / (labelled + weight) of the
    host's template, where p is the same of the parent domain's template of the path, p
    there that of the path in the tree of all hosts: (sum of the domains' rates + votes *
    prior) / (domains with labels + votes), so that no domain decides for the others
    however many pages it has.
    """
    domain = F.substring_index("host", ".", -2)
    counts = (
        pages.groupBy("host", _shapes("path").alias("shape"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("bad").alias("labelled"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        )
        .withColumn("domain", domain)
    )
    counts = saved(counts)
    scopes = F.array(F.concat(F.lit("h "), "host"), F.concat(F.lit("d "), "domain"), F.lit("a"))
    scoped = counts.select(F.explode(scopes).alias("scope"), "shape", *_SUMS)
    walked = saved(_walk(scoped.groupBy("scope", "shape").agg(*[F.sum(c).alias(c) for c in _SUMS]), vary, weight))
    totals = walked.groupBy("scope", "template").agg(*[F.sum(c).alias(c) for c in _SUMS])

    # All hosts: a vote for each domain that has labels below a template.
    anywhere = walked.where("scope = 'a'").select("shape", "template")
    voted = (
        counts.where("labelled > 0")
        .groupBy("domain", "shape")
        .agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        .join(anywhere, "shape")
        .groupBy("template", "domain")
        .agg((F.sum("bad") / F.sum("labelled")).alias("rate"))
        .groupBy("template")
        .agg(F.sum("rate").alias("rates"), F.count(F.lit(1)).alias("domains"))
    )
    far = anywhere.join(voted, "template", "left").select(
        "shape",
        ((F.coalesce("rates", F.lit(0.0)) + votes * prior) / (F.coalesce("domains", F.lit(0)) + votes)).alias("far"),
    )

    def within(letter: str, name: str) -> DataFrame:
        """Template and sums for each shape of the trees of a kind."""
        trees = walked.where(F.col("scope").startswith(f"{letter} ")).select("scope", "shape", "template")
        return trees.join(totals, ["scope", "template"]).select(
            F.substring("scope", 3, 1 << 30).alias(name), "shape", "template", *_SUMS
        )

    near = within("d", "domain").join(far, "shape").select(
        "domain", "shape", ((F.col("bad") + weight * F.col("far")) / (F.col("labelled") + weight)).alias("near")
    )
    own = within("h", "host").withColumn("domain", domain).join(near, ["domain", "shape"])
    purity = (F.col("bad") + weight * F.col("near")) / (F.col("labelled") + weight)
    return own.select("host", "shape", "template", *_SUMS, purity.alias("purity"), (purity >= reject_at).alias("rejected"))


def judge(pages: DataFrame, labels: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, **settings) -> DataFrame:
    """One row per page (page_id, url): host, path, rule, verdict, template and purity.

    A page that a rule fits gets the rule's verdict; any other is blocked if its template
    is rejected. Labels are `labels` (page_id, bad as 1 or 0; null ids and values are no
    labels, several of one page count as the worst) and, for pages without one, the
    verdicts of the rules. A null url, and one without `://`, has an empty host and path,
    which form a template like any other. A null page_id stays; repeated rows are
    repeated and count as often; no pages give no rows; other columns are not read.
    """
    url = F.col("url")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    ruled = F.lit(None).cast("string")
    for text, verdict in rules:
        ruled = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(ruled)
    rows = rows.withColumn("ruled", ruled).withColumn("bad", (F.col("ruled") == "block").cast("int"))
    if labels is not None:
        worst = labels.where("page_id is not null").groupBy(F.col("page_id").alias("labelled_id")).agg(F.max("bad").alias("own"))
        rows = rows.join(worst, F.col("page_id") == F.col("labelled_id"), "left").withColumn("bad", F.coalesce("own", "bad"))
    learned = templates(rows.select("host", "path", "bad"), **settings)
    shaped = rows.withColumn("shape", _shapes("path"))
    return shaped.join(learned.select("host", "shape", "template", "purity", "rejected"), ["host", "shape"]).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"),
        "template",
        "purity",
    )

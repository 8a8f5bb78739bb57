"""Commit mining: message and diff signals, their roll-up into candidates, filters and summaries.

Rule tables are literals, so every rule is a compiled pattern inside the generated code; signals of a commit meet in one
shuffle by commit.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.text import issue_ids, side

PRIORITY = {"structural": 3, "keyword": 2, "github": 2, "structural_partial": 1}
CONFIDENCES = ("low", "medium", "high")


def message(subject: str = "subject", body: str = "body") -> Column:
    """A commit's whole message, folded. Make it a column before rules look into it, else each makes it anew."""
    return R.folded(F.concat(F.coalesce(F.col(subject), F.lit("")), F.lit(" "), F.coalesce(F.col(body), F.lit(""))))


def stage1_category(text: Column) -> Column:
    """The first class, in fixed order, one of whose patterns occurs in a folded text; null if none."""
    return F.coalesce(*[F.when(R.any_of(R.said(text, p) for p in ps), F.lit(c)) for c, ps in R.STAGE1.items()])


def rejected(text: Column) -> Column:
    return R.any_of(R.said(text, p) for p in R.REJECT)


def plausible(both: Column, category: Column) -> Column:
    """Whether a source holds one of the words of its class; no class, no words."""
    return F.coalesce(*[F.when(category == c, R.any_of(F.contains(both, F.lit(w)) for w in ws)) for c, ws in R.PLAUSIBLE.items()], F.lit(False))


def keys_of(key: str | tuple[str, ...]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def keyword_hits(text: Column, keywords=R.KEYWORDS) -> Column:
    """struct(category, evidence) of each category of which keywords occur in a folded text."""
    groups: dict[str, list[str]] = {}
    for c, _, p in keywords:
        groups.setdefault(c, []).append(p)
    found = [F.struct(F.lit(c).alias("category"), F.filter(F.array(*[F.when(R.said(text, p), F.lit(p)) for p in ps]), lambda x: x.isNotNull()).alias("evidence")) for c, ps in groups.items()]
    return F.filter(F.array(*found), lambda x: F.size(x["evidence"]) > 0)


def keyword_signals(df: DataFrame, key: str | tuple[str, ...], text: Column, layer: int, keywords=R.KEYWORDS, source: str = "keyword") -> DataFrame:
    """key, category, source, layer, evidence: a row for each category of which keywords occur (case is ignored)."""
    key = keys_of(key)
    rows = df.select(*key, R.folded(text).alias("_text")).select(*key, F.explode(keyword_hits(F.col("_text"), keywords)).alias("x"))
    return rows.select(*key, "x.category", F.lit(source).alias("source"), F.lit(layer).alias("layer"), F.array_join("x.evidence", "|").alias("evidence"))


def label_signals(df: DataFrame, key: str | tuple[str, ...], labels: str = "github_labels", layer: int = 4, keywords=R.KEYWORDS) -> DataFrame:
    """Signals of the labels of issues that a commit names: keywords in any of them."""
    return keyword_signals(df, key, F.array_join(labels, "\n"), layer, keywords, "github")


def rules_of(taxonomy: DataFrame) -> tuple[list[tuple], list[tuple]]:
    """Keywords and diff patterns of a taxonomy (``sources.readers.taxonomy``) in the form of the built-in ones. A taxonomy is
    configuration, so its rows come to the driver and become literals of the plan; patterns that don't compile are
    left out, and those of sub-patterns stop a dot at a line end."""
    keywords, patterns = [], []
    for r in taxonomy.orderBy("category", "kind", "side", "ordinal", "pattern").collect():
        try:
            taxonomy.sparkSession._jvm.java.util.regex.Pattern.compile("(?dU)" + r["pattern"])
        except Exception:  # the engine's pattern syntax decides
            continue
        if r["kind"] == "keyword":
            keywords.append((r["category"], r["ordinal"], r["pattern"]))
        else:
            patterns.append((r["category"], r["ordinal"], r["side"], r["pattern"], "m" if r["kind"] == "sub" else "ms"))
    return keywords, patterns


def diff_signals(df: DataFrame, key: str | tuple[str, ...], diff: str = "diff", layer: int = 3, patterns=R.DIFF_PATTERNS) -> DataFrame:
    """Structural signals: patterns on both sides of a diff, or two or more on one side (partial)."""
    key = keys_of(key)
    d = df.select(*key, F.array_join(side(F.col(diff), "-"), "\n").alias("gone"), F.array_join(side(F.col(diff), "+"), "\n").alias("come"))
    groups: dict[str, list[tuple[str, str, str]]] = {}
    for c, _, s, p, *flags in patterns:
        groups.setdefault(c, []).append((s, p, flags[0] if flags else "ms"))
    found = [F.struct(F.lit(c).alias("category"), F.filter(F.array(*[F.when(R.has("gone" if s == "before" else "come", p, f), F.lit(f"{s}:{p}")) for s, p, f in ps]), lambda x: x.isNotNull()).alias("evidence")) for c, ps in groups.items()]
    rows = d.select(*key, F.explode(F.array(*found)).alias("x")).select(*key, "x.category", "x.evidence")
    both = F.exists("evidence", lambda e: e.startswith("before:")) & F.exists("evidence", lambda e: e.startswith("after:"))
    kind = F.when(both, "structural").when(F.size("evidence") >= 2, "structural_partial")
    return rows.select(*key, "category", kind.alias("source"), F.lit(layer).alias("layer"), F.array_join("evidence", "|").alias("evidence")).filter("source IS NOT NULL")


def strongest(signals: DataFrame, key: str | tuple[str, ...]) -> DataFrame:
    """One signal for each commit and category: by priority, then the earliest layer."""
    rank = F.coalesce(*[F.when(F.col("source") == s, p) for s, p in PRIORITY.items()], F.lit(0))
    w = W.partitionBy(*keys_of(key), "category").orderBy(rank.desc(), F.col("layer"))
    return signals.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def candidates(signals: DataFrame, key: str | tuple[str, ...]) -> DataFrame:
    """A row for each commit with its categories, parents and confidence. Forks share hashes, so that over several repositories
    the key is (repo, commit_hash)."""
    key = keys_of(key)

    def any_source(s: str) -> Column:
        return F.bool_or(F.col("source") == s)

    g = signals.groupBy(*key).agg(
        F.array_sort(F.collect_set("category")).alias("categories"),
        F.array_sort(F.collect_set(F.substring_index("category", ".", 1))).alias("parents"),
        F.count("*").cast("int").alias("signal_count"),
        any_source("structural").alias("st"),
        any_source("keyword").alias("kw"),
        any_source("github").alias("gh"),
    )
    high = F.col("st") & F.col("kw") & (F.col("gh") | (F.col("signal_count") >= 4))
    medium = F.col("kw") & (F.col("st") | F.col("gh"))
    return g.select(*key, "categories", "parents", (F.size("parents") >= 2).alias("is_multi_fault"), F.size("categories").alias("fault_count"), "signal_count", F.when(high, "high").when(medium, "medium").otherwise("low").alias("confidence"))


def parse_class_filter(raw: str) -> tuple[tuple[str, ...], bool]:
    """("LC", "ML+RL", "all") to the classes asked for and whether all of them must be present."""
    if raw.strip().lower() == "all":
        return (), False
    asked = {t.strip().upper() for t in raw.split("+")}
    if unknown := asked.difference(R.CLASSES):
        raise ValueError(f"unknown classes {sorted(unknown)}; known are {sorted(R.CLASSES)} and all")
    return tuple(sorted(asked)), len(asked) >= 2


def classes(parents: str = "parents") -> Column:
    """The paper classes of an array of parents, sorted."""
    return F.filter(F.array(*[F.when(F.array_contains(parents, p), F.lit(c)) for c, p in sorted(R.CLASSES.items())]), lambda x: x.isNotNull())


def class_filter(df: DataFrame, raw: str) -> DataFrame:
    asked, together = parse_class_filter(raw)
    if not asked:
        return df
    want = F.array(*[F.lit(c) for c in asked])
    return df.filter(F.size(F.array_except(want, classes())) == 0 if together else F.arrays_overlap(want, classes()))


def at_least(df: DataFrame, confidence: str) -> DataFrame:
    return df.filter(F.col("confidence").isin(*CONFIDENCES[CONFIDENCES.index(confidence) :]))


def class_breakdown(df: DataFrame) -> DataFrame:
    """How many candidates hold exactly the classes of each label, over all ten labels, zeros included."""
    labels = ["LC only", "ML only", "RL only", "LC+ML", "LC+RL", "ML+RL", "LC+ML+RL", "LC total", "ML total", "RL total"]
    c = classes()
    exact = F.array_join(c, "+")
    counts = [F.count_if(exact == x.removesuffix(" only")) if "total" not in x else F.count_if(F.array_contains(c, x.split()[0])) for x in labels]
    row = df.agg(*[n.alias(f"n{i}") for i, n in enumerate(counts)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"n{i}").cast("long").alias("n")) for i, x in enumerate(labels)])).alias("x")).select("x.*")


def repo_summary(df: DataFrame, repo: str = "repo") -> DataFrame:
    """Totals, multi-fault totals and counts by confidence of each repository, zeros included."""
    return df.groupBy(repo).agg(F.count("*").alias("total"), F.count_if("is_multi_fault").alias("multi"), *[F.count_if(F.col("confidence") == c).alias(c) for c in CONFIDENCES])


def repo_breakdown(df: DataFrame, repo: str = "repo") -> DataFrame:
    """repo, kind (parent, category, combo), name, n: candidates of each parent and category, and multi-fault ones by their parents joined."""

    def kind(name: str, items: Column) -> Column:
        return F.transform(items, lambda x: F.struct(F.lit(name).alias("kind"), x.alias("name")))

    combo = F.when(F.col("is_multi_fault"), F.array(F.array_join("parents", "+"))).otherwise(F.array().cast("array<string>"))
    rows = df.select(repo, F.explode(F.concat(kind("parent", F.col("parents")), kind("category", F.col("categories")), kind("combo", combo))).alias("x"))
    return rows.groupBy(repo, "x.kind", "x.name").agg(F.count("*").alias("n"))


def with_issues(df: DataFrame, key: str | tuple[str, ...], text: Column, issues: DataFrame) -> DataFrame:
    """key, n_ids and the labels of the issues that a message names, duplicates kept; ids that aren't known add none."""
    key = keys_of(key)
    ids = df.select(*key, F.explode_outer(issue_ids(text)).alias("issue_id"))
    hit = ids.join(issues, "issue_id", "left")
    return hit.groupBy(*key).agg(F.count("issue_id").cast("int").alias("n_ids"), F.array_sort(F.flatten(F.collect_list("labels"))).alias("labels"))


def with_pull_request(df: DataFrame, prs: DataFrame, key: str | tuple[str, ...] = "commit_hash") -> DataFrame:
    """Left lookup; absent gives a null number and empty texts. The body, if there is one, is cut to its first 300 characters."""
    out = df.join(prs, keys_of(key), "left")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("pr_url", "pr_title")]
    if "pr_body" in prs.columns:
        texts.append(F.substring(F.coalesce("pr_body", F.lit("")), 1, 300).alias("pr_body_snippet"))
    return out.select(*df.columns, "pr_number", *texts)


def merged_only(df: DataFrame, prs: DataFrame, active: bool = True, key: str | tuple[str, ...] = "commit_hash") -> DataFrame:
    """Commits of merged pull requests; all of them if the filter is off or no pull request is merged."""
    merged = prs.filter("merged").select(*keys_of(key)).distinct()
    return df if not active or merged.isEmpty() else df.join(merged, keys_of(key), "left_semi")


def commit_link(repo: Column, commit: Column, given: Column | None = None) -> Column:
    """The address of a commit: the given one, else made from the names."""
    made = F.concat(F.lit("https://github.com/"), repo, F.lit("/commit/"), commit)
    return made if given is None else F.coalesce(F.nullif(given, F.lit("")), made)


def traceability(repo: Column, commit: Column, number: str = "pr_number", title: str = "pr_title", url: str = "pr_url", given: Column | None = None) -> Column:
    """What leads from a pair to its pull request and commit; without a number or an address of the request, to the commit alone."""
    link = commit_link(repo, commit, given)
    n, u = F.coalesce(F.col(number).cast("string"), F.lit("")), F.coalesce(F.col(url), F.lit(""))
    head = F.substring(F.coalesce(F.col(title), F.lit("")), 1, 80)
    pr = F.concat(F.lit("PR #"), n, F.when(head != "", F.concat(F.lit(" · "), head)).otherwise(""), F.lit(" | PR: "), u, F.lit(" | Commit: "), link)
    return F.when((n != "") & (u != ""), pr).otherwise(F.concat(F.lit("Commit: "), link))


def with_project(df: DataFrame, projects: DataFrame, path: str = "repo") -> DataFrame:
    """df with project: the name that ``projects`` (path, project) gives to a repository, else its last path segment."""
    known = projects.select(F.col("path").alias("p_"), F.col("project").alias("n_"))
    out = df.join(known, F.col(path) == F.col("p_"), "left")
    return out.select(*[df[c] for c in df.columns], F.coalesce("n_", F.element_at(F.split(path, "/", -1), -1)).alias("project"))


def overlay(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Columns of both by key; where both have a column, the right value wins unless it is null or the row is absent."""
    r = right.select(F.col(key), *[F.col(c).alias(f"_r_{c}") for c in right.columns if c != key])
    both = left.join(r, key, "left")
    shared = [c for c in right.columns if c != key]
    return both.select(key, *[F.coalesce(f"_r_{c}", c).alias(c) if c in shared else F.col(c) for c in left.columns if c != key], *[F.col(f"_r_{c}").alias(c) for c in shared if c not in left.columns])


def allowed(df: DataFrame, projects: list[str], column: str = "project") -> DataFrame:
    """Rows of the named projects; no names, all rows. A warning names projects that no row has."""
    for unknown in sorted(set(projects).difference(r[0] for r in df.filter(F.col(column).isin(*projects)).select(column).distinct().collect())) if projects else ():
        warnings.warn(f"no project {unknown}", stacklevel=2)
    return df.filter(F.col(column).isin(*projects)) if projects else df

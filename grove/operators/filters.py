"""Ordered glob rules: the last that matches a path decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.functions.paths import glob_regex, name, under

Rule = tuple[str, bool, bool]
#: Names that are ignored whatever the rules.
ALWAYS = (".grove",)
#: Ends of the files that a merge leaves beside a conflict: ignored too.
SIDECARS = (".mine", ".theirs", ".base")


def parse(lines: list[str]) -> list[Rule]:
    """(regular expression, negated, directory) in order, from lines of globs; `!` includes, `#` and empty lines say nothing.

    A glob without a slash within and none at its start is one for names, anywhere. An exclusion also excludes all
    below. An inclusion includes the directories above, as directories, and all below; it may not start with `**`.
    """
    rules: list[Rule] = []
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        glob = line[negated:]
        directory = glob.endswith("/")
        anywhere = "/" not in glob.rstrip("/")
        glob = glob.strip("/")
        if negated and glob.startswith("**"):
            raise ValueError(f"an inclusion can't start with **: {line}")
        if negated and not anywhere:
            parts = glob.split("/")
            rules += [(glob_regex("/".join(parts[:i])), True, True) for i in range(1, len(parts))]
        base = f"**/{glob}" if anywhere else glob
        rules += [(glob_regex(base), negated, directory), (glob_regex(f"{base}/**"), negated, False)]
    return rules


def load(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a filter file, in order of lines."""
    return parse([r.value for r in spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "\\r?\\n")).alias("value")).collect()])


def readable(tree: DataFrame, allowed: DataFrame, column: str = "repository") -> DataFrame:
    """Rows of repositories that may be read (repository)."""
    return tree.join(allowed.select(F.col("repository").alias(column)).distinct(), column, "left_semi")


def viewed_links(links: DataFrame, rules: list[Rule]) -> DataFrame:
    """Links (mount) that a view doesn't exclude, as directories."""
    return links.where(~excluded("mount", rules, True))


def excluded(path: Column | str, rules: list[Rule], is_dir: Column | bool = False) -> Column:
    """Whether the last matching rule excludes a path. The rules are few and part of the plan: no join, no shuffle."""
    low = F.lower(path)
    is_dir = F.lit(is_dir) if isinstance(is_dir, bool) else is_dir
    out = F.lit(False)
    for regex, negated, directory in rules:
        hit = low.rlike(regex) & is_dir if directory else low.rlike(regex)
        out = F.when(hit, F.lit(not negated)).otherwise(out)
    dots = lambda names: "|".join(x.replace(".", "\\.") for x in names)
    return out | low.rlike(f"(^|/)({dots(ALWAYS)})(/|$)") | low.rlike(f"[^/]({dots(SIDECARS)})$")


def judged(tree: DataFrame, ignore: list[Rule], view: list[Rule]) -> DataFrame:
    """tree with reason: `ignore` or `view` where a rule list excludes a path, else null."""
    return tree.withColumn("reason", F.when(excluded("path", ignore), "ignore").when(excluded("path", view), "view"))


def only_changed(tree: DataFrame, changes: DataFrame) -> DataFrame:
    """Files that a change set names: a view made from changes."""
    return tree.join(changes.select(F.lower("path").alias("_k")).distinct(), F.lower(tree["path"]) == F.col("_k"), "left_semi")


def minimal(paths: DataFrame) -> DataFrame:
    """Paths that no other path of the set covers: a path goes if one of its ancestors is there. An equi-join on ancestors."""
    from grove.functions.paths import ancestors

    distinct = paths.select("path").distinct()
    above = distinct.select("path", F.explode(ancestors("path")).alias("above"))
    covered = above.join(distinct.select(F.col("path").alias("above")), "above", "left_semi").select("path").distinct()
    return distinct.join(covered, "path", "left_anti")


def tagged(rows: DataFrame, tags: list[str], column: str = "tags") -> DataFrame:
    """Rows with any of the tags; no tags keep all."""
    return rows.where(F.arrays_overlap(column, F.array(*map(F.lit, tags)))) if tags else rows


def in_layer(tree: DataFrame, mounts: list[str]) -> DataFrame:
    out = F.lit(False)
    for m in mounts:
        out = out | under("path", F.lit(m))
    return tree.withColumn("masked", out)


def by_name(tree: DataFrame, glob: str) -> DataFrame:
    return tree.where(F.lower(name("path")).rlike(glob_regex(glob)))

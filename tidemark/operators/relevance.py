"""Relevance of files: direct references, and what imports them, transitively."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.source_code import imports_of
from tidemark.operators.dialect import to_java
from tidemark.sources.tables import stage


def direct_relevance(files: DataFrame, regex: str, key: str = "file") -> DataFrame:
    """(key): texts that match anywhere, and unreadable ones, since nothing is certain about those."""
    test = F.col("text").rlike(to_java(regex))
    if "error" in files.columns:
        test = test | F.col("error").isNotNull()
    return files.where(F.coalesce(test, F.lit(True) if "error" in files.columns else F.lit(False))).select(key).distinct()


def dotted_names(files: DataFrame) -> DataFrame:
    """(file, dotted, package): module name below the outermost directory that has no ``__init__.py``.

    Climbing stops at the first directory without one, so the depth is that of
    the deepest missing ancestor.
    """
    parts = F.split("file", "/")
    base = files.select("file", parts.alias("parts")).withColumn("depth", F.size("parts") - 1)
    packages = files.where(F.col("file").endswith("__init__.py")).select(F.regexp_replace("file", "/?__init__.py$", "").alias("dir"), F.lit(True).alias("is_package"))
    up = base.select("file", "depth", F.explode_outer(F.when(F.col("depth") > 0, F.sequence(F.lit(1), "depth"))).alias("level"), "parts")
    up = up.withColumn("dir", F.array_join(F.slice("parts", F.lit(1), F.coalesce("level", F.lit(0))), "/"))
    root = up.join(packages, "dir", "left").groupBy("file").agg(F.coalesce(F.max(F.when(F.col("is_package").isNull(), F.col("level"))), F.lit(0)).alias("root"))
    named = base.join(root, "file")
    is_init = F.element_at("parts", -1) == "__init__.py"
    folders = F.slice("parts", F.col("root") + 1, F.col("depth") - F.col("root"))
    module = F.when(is_init, folders).otherwise(F.concat(folders, F.array(F.regexp_replace(F.element_at("parts", -1), r"\.py$", ""))))
    return named.select("file", F.array_join(module, ".").alias("dotted"), folders.alias("package"))


def import_edges(files: DataFrame, keep_all_targets: bool = False) -> DataFrame:
    """(src, dst): files that import files of the same tree.

    Where files share a dotted name, the last by path is meant, or with
    ``keep_all_targets`` every one of them.  A file that does not parse has no
    edges; see :func:`relevant_files` for the strict treatment.
    """
    names = dotted_names(files)
    targets = names.select("dotted", F.col("file").alias("dst"))
    if not keep_all_targets:
        targets = targets.groupBy("dotted").agg(F.max("dst").alias("dst"))
    found = files.join(names, "file").select(F.col("file").alias("src"), F.explode(imports_of("text", "package")).alias("dotted"))
    return found.join(targets, "dotted").where("src <> dst").select("src", "dst").distinct()


def closure(seeds: DataFrame, edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, round): everything from which a seed can be reached along ``edges`` (src, dst).

    Each round joins only the nodes that the last one added, so an edge is
    used once; cycles end by themselves.  Rounds are written tables.  With
    ``rounds``, an incomplete result after so many is an error.
    """
    reached = frontier = stage(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct().withColumn("round", F.lit(0)), "closure")
    edges = stage(edges.select("src", "dst"), "closure-edges")
    for n in count(1):
        new = edges.join(frontier.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        frontier = stage(new.join(reached, "node", "left_anti").withColumn("round", F.lit(n)), "closure")
        if not frontier.limit(1).count():
            return reached
        if rounds is not None and n > rounds:
            raise RuntimeError(f"the closure is not complete after {rounds} rounds")
        reached = reached.unionByName(frontier)


def closure_through(seeds: DataFrame, membership: DataFrame, member: str, group: str) -> DataFrame:
    """(member, round): members linked to a seed through shared groups, without listing pairs of members.

    ``membership`` holds (member, group).  A round goes from new members to
    their groups, and from groups not seen before to all of their members.
    Groups, which may be long texts, are numbered once; groups of one member
    link nobody and are left out.  Rounds move numbers only.
    """
    given = stage(membership.select(F.col(member).alias("_member"), F.col(group).alias("_group")).where(F.col(member).isNotNull() & F.col(group).isNotNull()), "membership")
    shared = given.groupBy("_group").agg((F.min("_member") != F.max("_member")).alias("_many")).where("_many").select("_group", F.monotonically_increasing_id().alias("_number"))
    links = stage(given.join(stage(shared, "closure-numbers"), "_group").select(F.col("_member").alias(member), "_number").distinct(), "closure-links")
    group = "_number"
    reached = frontier = stage(seeds.select(member).distinct().withColumn("round", F.lit(0)), "closure")
    seen = None
    n = 0
    while frontier.limit(1).count():
        n += 1
        groups = links.join(frontier.select(member), member, "left_semi").select(group).distinct()
        groups = stage(groups if seen is None else groups.join(seen, group, "left_anti"), "closure-groups")
        seen = groups if seen is None else seen.unionByName(groups)
        members = links.join(groups, group, "left_semi").select(member).distinct()
        frontier = stage(members.join(reached, member, "left_anti").withColumn("round", F.lit(n)), "closure")
        reached = reached.unionByName(frontier)
    return reached


def relevant_files(files: DataFrame, regex: str, transitive: bool = True, strict_failsafe: bool = False) -> DataFrame:
    """(file): files relevant to the change.

    ``strict_failsafe`` also counts files that do not parse, whose imports are
    unknown.
    """
    direct = direct_relevance(files, regex)
    if strict_failsafe:
        from tidemark.functions.source_code import parse_error

        direct = direct.unionByName(files.where(F.col("text").isNotNull()).withColumn("bad", parse_error("text")).where("bad IS NOT NULL").select("file")).distinct()
    if not transitive:
        return direct
    return closure(direct, import_edges(files, keep_all_targets=strict_failsafe)).select(F.col("node").alias("file"))

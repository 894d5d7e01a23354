"""Whether sessions belong to a repository, where they ran, and whether that place can come back.

Directory facts arrive as tables: identity (directory, canonical, common_dir), inventories of refs and worktrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SESSION = ["agent", "home", "session_id"]
# Why a session is not listed.
CONFLICT = "has conflicting repository identity evidence; its recorded directories cannot unambiguously belong to this destination"
NO_REPOSITORY = "records no repository, so it cannot be listed here"
UNRESOLVED = "has unresolved recorded directories with no matching repository evidence"
MISSING = "has only missing recorded directories; repository membership cannot be established"


def membership(recorded: DataFrame, identity: DataFrame, destination: str, common_dir: str | None, starts: DataFrame | None = None) -> DataFrame:
    """One row per session: matched, conflicting, existing, started_here, member.

    recorded has the session keys and a directory per row (null for a session without any); identity knows the existing
    directories. A session is a member if a directory is the destination or shares its repository and none is of another
    repository; the start directory, if given, decides only where nothing matched or conflicted.
    """
    known = identity.select(F.col("directory").alias("of"), F.coalesce("canonical", "directory").alias("canonical"), "common_dir")
    ours = F.lit(common_dir).cast("string")
    here = (F.col("canonical") == destination) | F.coalesce(F.col("common_dir") == ours, F.lit(False))
    other = F.col("common_dir").isNotNull() & ~F.col("common_dir").eqNullSafe(ours)
    # One row for each directory of a session, however often it is recorded.
    rows = recorded.select(*SESSION, "directory").distinct().join(known, F.col("directory") == F.col("of"), "left")
    flags = rows.groupBy(*SESSION).agg(
        F.coalesce(F.bool_or(here & F.col("of").isNotNull()), F.lit(False)).alias("matched"),
        F.coalesce(F.bool_or(other & F.col("of").isNotNull()), F.lit(False)).alias("conflicting"),
        F.bool_or(F.col("of").isNotNull()).alias("existing"),
        F.count("directory").alias("recorded"),
    )
    if starts is not None:
        own = recorded.select(*SESSION, F.col("directory").alias("start_directory")).distinct()
        fresh = starts.select(*SESSION, "start_directory").join(own, [*SESSION, "start_directory"], "left_anti")
        began = fresh.join(known, F.col("start_directory") == F.col("of")).select(*SESSION, here.alias("began")).groupBy(*SESSION).agg(F.bool_or("began").alias("began"))
        flags = flags.join(began, SESSION, "left")
    else:
        flags = flags.withColumn("began", F.lit(None).cast("boolean"))
    here_now = F.col("matched") & ~F.col("conflicting")
    started = ~here_now & ~F.col("conflicting") & F.coalesce("began", F.lit(False))
    return flags.withColumns({"started_here": started, "member": here_now | started}).drop("began")


def reject_reason() -> Column:
    """Why a session of membership() is not listed; null for members."""
    return (
        F.when(F.col("member"), F.lit(None).cast("string")).when(F.col("conflicting"), F.lit(CONFLICT)).when(F.col("recorded") == 0, F.lit(NO_REPOSITORY))
        .when(F.col("existing"), F.lit(UNRESOLVED)).otherwise(F.lit(MISSING))
    )


def differs_from(recorded: DataFrame, identity: DataFrame, destination: str) -> DataFrame:
    """Per session whether an existing recorded directory is not the destination; missing ones are neutral."""
    known = identity.select(F.col("directory").alias("of"), F.coalesce("canonical", "directory").alias("canonical"))
    rows = recorded.join(known, F.col("directory") == F.col("of"), "left")
    return rows.groupBy(*SESSION).agg(F.coalesce(F.bool_or(F.col("canonical") != destination), F.lit(False)).alias("other_directory"))


def one_spelling(rows: DataFrame, aliases: DataFrame, path: str, *rank: str) -> DataFrame:
    """Rows with one row for each canonical path: the first by `rank`. Hot paths are pre-aggregated before the shuffle."""
    known = aliases.select(F.col("path").alias("of"), F.col("canonical").alias("to"))
    named = rows.join(known, F.col(path) == F.col("of"), "left").withColumn("canonical_path", F.coalesce("to", path)).drop("of", "to")
    columns = [c for c in named.columns if c != "canonical_path"]
    first = named.groupBy("canonical_path").agg(F.min(F.struct(*rank, *[c for c in columns if c not in rank])).alias("first"))
    return first.select(*[F.col(f"first.{c}").alias(c) for c in columns], "canonical_path")


def parent_repository(directory: Column) -> Column:
    """Repositories that a removed worktree's path points to, likeliest first."""
    patterns = (r"^(.*)/\.(?:[A-Za-z0-9_-]+)/worktrees/[^/]+(?:/.*)?$", r"^(.*)/\.worktrees/[^/]+(?:/.*)?$", r"^(.*)/worktrees/[^/]+(?:/.*)?$")
    found = [F.regexp_extract(directory, p, 1) for p in patterns]
    return F.array_distinct(F.filter(F.array(*found), lambda x: x != ""))


def place(catalog: DataFrame, directories: DataFrame, repositories: DataFrame) -> DataFrame:
    """catalog with directory, place (present, recoverable, unrecoverable) and recovery repository.

    directories (directory, branch) exist now; repositories (root) can hold worktrees. A missing directory can be
    recovered from the first candidate repository that exists.
    """
    rows = catalog.withColumn("directory", F.coalesce("start_directory", "repo_path", F.lit("")))
    present = directories.select(F.col("directory").alias("of"), F.col("branch").alias("now_branch"))
    rows = rows.join(present, F.col("directory") == F.col("of"), "left")
    missing = rows.where(F.col("of").isNull()).select("directory").distinct()
    candidates = missing.select("directory", F.posexplode(parent_repository(F.col("directory"))).alias("rank", "candidate"))
    found = candidates.join(repositories.select(F.col("root").alias("candidate")).distinct(), "candidate")
    best = found.groupBy(F.col("directory").alias("lost")).agg(F.min_by("candidate", "rank").alias("recovery_root"))
    rows = rows.join(best, F.col("directory") == F.col("lost"), "left").drop("lost")
    state = F.when(F.col("of").isNotNull(), F.lit("present")).when(F.col("recovery_root").isNotNull(), F.lit("recoverable")).otherwise(F.lit("unrecoverable"))
    moved = F.col("of").isNotNull() & F.col("branch").isNotNull() & F.col("now_branch").isNotNull() & (F.col("branch") != F.col("now_branch"))
    return rows.withColumns({"place": state, "branch_moved": moved}).drop("of")


def recovery_reference(placed: DataFrame, refs: DataFrame, worktrees: DataFrame) -> DataFrame:
    """start_ref and warning for recoverable sessions: the free local branch, else origin's, else the commit, else HEAD.

    refs (root, ref) lists branches and commits of repositories; worktrees (root, branch) are checked out elsewhere.
    """
    rows = placed.where(F.col("place") == "recoverable")
    known = lambda ref, name: refs.select(F.col("root").alias("recovery_root"), F.col("ref").alias(ref)).distinct().withColumn(name, F.lit(True))
    rows = rows.withColumns({"_local": F.col("branch"), "_origin": F.concat(F.lit("origin/"), F.col("branch")), "_commit": F.col("commit")})
    for ref, name in (("_local", "_has_local"), ("_origin", "_has_origin"), ("_commit", "_has_commit")):
        rows = rows.join(known(ref, name), ["recovery_root", ref], "left")
    busy = worktrees.select(F.col("root").alias("recovery_root"), F.col("branch").alias("_local")).distinct().withColumn("_busy", F.lit(True))
    rows = rows.join(busy, ["recovery_root", "_local"], "left")
    start = (
        F.when(F.col("_has_local") & F.col("_busy").isNull(), F.col("_local")).when(F.col("_has_origin"), F.col("_origin"))
        .when(F.col("_has_commit"), F.col("_commit")).otherwise(F.lit("HEAD"))
    )
    warning = F.when(start == "HEAD", F.lit("The recorded branch and commit are gone; the worktree starts at HEAD.")).when(F.col("_busy") & F.col("_has_local"), F.lit("The recorded branch is checked out elsewhere."))
    return rows.withColumns({"start_ref": start, "recovery_warning": warning}).drop("_local", "_origin", "_commit", "_has_local", "_has_origin", "_has_commit", "_busy")


def destination_status(asked: DataFrame, identity: DataFrame) -> DataFrame:
    """dest_status for rows with place, directory, recovery_root and asked (a directory to import into instead, or null)."""
    def of(prefix: str) -> DataFrame:
        return identity.select(F.col("directory").alias(f"{prefix}_of"), F.col("common_dir").alias(f"{prefix}_common"))

    anchor = F.when(F.col("place") == "recoverable", F.col("recovery_root")).otherwise(F.col("directory"))
    rows = asked.withColumn("anchor", anchor)
    rows = rows.join(of("to"), F.col("asked") == F.col("to_of"), "left").join(of("at"), F.col("anchor") == F.col("at_of"), "left")
    same = (F.col("to_common") == F.col("at_common")) | (F.col("asked") == F.col("anchor"))
    status = (
        F.when(F.col("asked").isNull() & (F.col("place") == "present"), F.lit("recorded")).when(F.col("asked").isNull(), F.lit("missing"))
        .when(F.col("to_of").isNull(), F.lit("no-directory"))
        .when(F.col("place") == "unrecoverable", F.when(F.col("to_common").isNotNull(), F.lit("ok")).otherwise(F.lit("not-a-checkout")))
        .when(F.coalesce(same, F.lit(False)), F.lit("ok")).otherwise(F.lit("other-repository"))
    )
    return rows.withColumn("dest_status", status).drop("to_of", "to_common", "at_of", "at_common", "anchor")

"""The live branch of parent-pointer entries, and what a compaction leaves of it.

Sessions whose entries form one chain in file order are settled by windows. Only the others go through pointer doubling:
each round joins the path found so far with jumps of twice the length, so a path of depth d takes log2(d) rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import written

SESSION = ["agent", "home", "session_id"]


def defects(entries: DataFrame, label: str = "uuid") -> DataFrame:
    """Sessions (with reason) that have entries without a usable id, or with an id twice. entries: keys, pos, id, parent."""
    bad = entries.groupBy(*SESSION).agg(F.min_by("pos", F.when(F.col("id").isNull() | (F.col("id") == ""), F.col("pos"))).alias("unnamed"))
    twice = entries.groupBy(*SESSION, "id").agg(F.count("*").alias("n"), F.max("pos").alias("last")).where("n > 1 and id is not null")
    doubled = twice.groupBy(*SESSION).agg(F.min_by("id", "last").alias("twice"))
    rows = bad.join(doubled, SESSION, "left").where("unnamed is not null or twice is not null")
    reason = F.when(F.col("unnamed").isNotNull(), F.lit(f"entry has no {label}")).otherwise(F.concat(F.lit(f"duplicate entry {label} "), "twice"))
    return rows.select(*SESSION, reason.alias("reason"))


def active_path(entries: DataFrame, label: str = "uuid") -> tuple[DataFrame, DataFrame]:
    """(keys, pos, depth) of the entries from the root to the last entry, and rejects (keys, reason).

    entries has the keys, pos, id and parent (null at a root), without entries that are off every chain; it is read
    several times, so it should be a table. Rejected are sessions with defects, with a missing parent on the path, or
    with a cycle.
    """
    rows = entries.select(*SESSION, "pos", "id", "parent")
    wrong = defects(rows, label)
    sound = rows.join(wrong.select(*SESSION), SESSION, "left_anti")
    w = Window.partitionBy(*SESSION).orderBy("pos")
    chained = sound.withColumns({"depth": F.row_number().over(w) - 1, "before": F.lag("id").over(w)})
    follows = F.col("before").eqNullSafe(F.col("parent"))
    plain = chained.withColumn("chain", F.bool_and(follows).over(Window.partitionBy(*SESSION)))
    plain = written(plain, "branch-chains")
    simple = plain.where("chain").select(*SESSION, "pos", F.col("depth").cast("long").alias("depth"))
    branched = plain.where("not chain").select(*SESSION, "pos", "id", "parent")
    most = branched.groupBy(*SESSION).count().agg(F.max("count")).first()[0]
    if not most:
        return simple, wrong
    jumps = branched.select(*SESSION, "id", F.col("parent").alias("up"))
    leaf = branched.groupBy(*SESSION).agg(F.max_by("id", "pos").alias("id"))
    path = leaf.select(*SESSION, "id", F.lit(0).cast("long").alias("steps"))
    for k in range(math.ceil(math.log2(most)) + 1):
        near = path.join(jumps, [*SESSION, "id"]).where("up is not null")
        path = written(path.unionByName(near.select(*SESSION, F.col("up").alias("id"), (F.col("steps") + (1 << k)).alias("steps"))), "branch-path")
        onward = jumps.select(*SESSION, F.col("id").alias("up"), F.col("up").alias("further"))
        jumps = written(jumps.where("up is not null").join(onward, [*SESSION, "up"]).select(*SESSION, "id", F.col("further").alias("up")), "branch-jumps")
    size = branched.groupBy(*SESSION).agg(F.count("*").alias("n"))
    # A path of more steps than the session has entries goes round in a cycle; an id that no entry has is missing.
    round_ = path.join(size, SESSION).where("steps >= n").select(*SESSION, F.lit("parents form a cycle").alias("reason")).distinct()
    known = branched.select(*SESSION, "id", "pos")
    lost = path.join(known, [*SESSION, "id"], "left_anti").groupBy(*SESSION).agg(F.min_by("id", "steps").alias("id"))
    lost = lost.join(round_.select(*SESSION), SESSION, "left_anti").select(*SESSION, F.concat(F.lit("an entry refers to missing parent "), "id").alias("reason"))
    rejects = written(round_.unionByName(lost), "branch-rejects")
    good = path.join(rejects.select(*SESSION), SESSION, "left_anti")
    far = good.groupBy(*SESSION).agg(F.max("steps").alias("far"))
    found = good.join(far, SESSION).join(known, [*SESSION, "id"]).select(*SESSION, "pos", (F.col("far") - F.col("steps")).alias("depth"))
    return simple.unionByName(found), wrong.unionByName(rejects)


def off_path(entries: DataFrame, path: DataFrame) -> DataFrame:
    """Entries that the live path leaves out: keys, pos, type, reason ("sidechain", "no id" or "other branch").

    entries has the keys, pos, id, type and, where the layout has sidechains, `side`; path is the one of active_path().
    Sessions without a path (rejected ones) have all their entries here.
    """
    side = F.coalesce(F.col("side"), F.lit(False)) if "side" in entries.columns else F.lit(False)
    reason = F.when(side, F.lit("sidechain")).when(F.coalesce("id", F.lit("")) == "", F.lit("no id")).otherwise(F.lit("other branch"))
    left = entries.join(path.select(*SESSION, "pos"), [*SESSION, "pos"], "left_anti")
    return left.select(*SESSION, "pos", "type", reason.alias("reason"))


def skipped(off: DataFrame) -> DataFrame:
    """Per session how many entries off_path() gives, and their types in order (a type that is null counts as "")."""
    counted = off.groupBy(*SESSION, F.coalesce("type", F.lit("")).alias("type")).agg(F.count("*").alias("n"))
    return counted.groupBy(*SESSION).agg(F.sum("n").alias("skipped"), F.array_sort(F.collect_list("type")).alias("types"))


def compacted(path: DataFrame) -> DataFrame:
    """What the last compaction of each path leaves, in order: `part` 0 the compaction, 1 kept or retained, 2 after it.

    path has the keys, depth, id, type, first_kept (an id) and retained (an array, null or empty if none). Entries come
    back with `part`, `place` in it and `item` (a retained element, else null).
    """
    whole = Window.partitionBy(*SESSION)
    rows = path.withColumn("_cut", F.max(F.when(F.col("type") == "compaction", F.col("depth"))).over(whole))
    at_cut = F.col("depth") == F.col("_cut")
    rows = rows.withColumns({
        "_kept_id": F.max(F.when(at_cut, F.col("first_kept"))).over(whole),
        "_n_retained": F.coalesce(F.max(F.when(at_cut, F.greatest(F.size("retained"), F.lit(0)))).over(whole), F.lit(0)),
    })
    rows = rows.withColumn("_from", F.min(F.when((F.col("id") == F.col("_kept_id")) & (F.col("depth") < F.col("_cut")), F.col("depth"))).over(whole))
    kept = (F.col("_n_retained") == 0) & (F.col("depth") >= F.col("_from")) & (F.col("depth") < F.col("_cut"))
    part = F.when(F.col("_cut").isNull(), 2).when(at_cut, 0).when(F.col("depth") > F.col("_cut"), 2).when(kept, 1)
    none = F.lit(None).cast(path.schema["retained"].dataType.elementType)
    rows = rows.withColumn("part", part)
    own = rows.where("part is not null").withColumns({"place": F.col("depth"), "item": none})
    tail = rows.where(at_cut & (F.col("_n_retained") > 0)).select("*", F.posexplode("retained").alias("_p", "item"))
    tail = tail.withColumns({"part": F.lit(1), "place": F.col("_p").cast("long")}).drop("_p")
    return own.unionByName(tail).drop("_cut", "_kept_id", "_n_retained", "_from")

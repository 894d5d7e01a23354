"""Mixing sources to target weights, exact to the word.

Sources are ordered by code point, null last, and take the given weights in turn, repeating. A share of all words is
divided by weight; no source gets more than `most_epochs` times its own words, and what that leaves over goes to the
others by weight until none is above. Each source repeats whole epochs and then takes documents in the order of a hash
of doc_id, epoch and text, with the running sum of words from bucketed prefix sums, up to its exact budget; the document
on the boundary is cut there.

Defined results: null and empty texts have size 0 and take 0; a null doc_id hashes as the word "null", and the text
tells rows of one id apart, so that reruns take the same ones; rows equal in id and text are separate documents whose
order does not show; other columns pass through or are ignored; an empty table gives an empty mix. Sources are
assumed to be few against documents (one row each in the plan).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.prefix_sums import bucket_of, bucket_offsets, running_sums, total_buckets
from turnloom.llm.rows import packed_row
from turnloom.session import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """sizes (source, source_size) with the target of each: weights fill up, the sources below their limit share the rest.

    In order of limit per weight a source is at its limit exactly if its limit is at most its weighted share of what
    the sources before it leave.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("double")
    ranked = sizes.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(most_epochs))
    fill = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    pool = F.sum("source_size").over(everything) * share
    left = ranked.select(
        "*",
        (pool - F.coalesce(F.sum("limit").over(before), F.lit(0.0))).alias("rest"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("sharers"),
    )
    marked = left.withColumn("full", F.col("limit") * F.col("sharers") <= F.col("weight") * F.col("rest"))
    final = marked.select(
        "*",
        F.min(F.when(~F.col("full"), F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), "source", "rest", "sharers"))).over(everything).alias("open"),
    )
    target = F.when(F.col("full"), F.col("limit")).otherwise(F.col("weight") * F.col("open.rest") / F.col("open.sharers"))
    return final.select("source", "source_size", target.alias("target"))


def _planned(sizes: DataFrame, counts: Column, partitions: int, **options) -> DataFrame:
    plan = targets(sizes.select("source", "source_size"), **options)
    rows = sizes.select(F.col("source").alias("of"), "n")
    whole = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    shared = F.greatest(F.lit(1), F.ceil(F.col("n") * partitions / F.sum("n").over(Window.partitionBy())))
    return (
        plan.join(rows, F.col("source").eqNullSafe(F.col("of")))
        .select("of", "source_size", "target", whole.alias("epochs"), (F.round("target").cast("long") - whole * F.col("source_size")).alias("rest"), shared.cast("long").alias("buckets"))
    )


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS, keep_rows: bool = False) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words), copies (times the document is used).

    With keep_rows, `row` holds the whole input row as well. Texts are then read twice: for the plan and for the rows.
    """
    spark = documents.sparkSession
    digits = F.substring(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")), 1, 12).alias("digits")
    thin = written(documents.select("doc_id", "source", digits, word_count(F.col("text")).alias("size")), "mix-sizes")
    sizes = thin.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = written(_planned(sizes, F.col("n"), total_buckets(spark), weights=weights, share=share, most_epochs=most_epochs), "mix-plan")
    # 60 bits of an MD5, which other engines have too, spread over the signed 64-bit numbers.
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("epochs").cast("string"), F.col("digits"))
    key = (F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long") - F.lit(1 << 59)) * F.lit(16)

    def placed(rows: DataFrame) -> DataFrame:
        joined = rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).drop("of")
        return joined.withColumn("key", key).withColumn("bucket", bucket_of(F.col("key"), F.col("buckets")))

    offsets = written(bucket_offsets(placed(thin), "source", F.col("size")), "mix-offsets")
    source = thin
    if keep_rows:
        source = documents.select(packed_row(documents), "doc_id", "source", digits, word_count(F.col("text")).alias("size"))
    sums = running_sums(placed(source), offsets, "source", ["key", "doc_id", "digits", "size"], F.col("size"), "before")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    copies = (F.col("epochs") + (F.col("before") < F.col("rest")).cast("long")).alias("copies")
    taken = (F.col("epochs") * F.col("size") + last).cast("long").alias("taken")
    return sums.select("doc_id", "size", "source_size", "target", taken, copies, *["row"] * keep_rows)


def digest(result: DataFrame) -> DataFrame:
    """The contract's columns of a result of mix()."""
    return result.select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each repeated as often as it is used; a boundary document is used whole."""
    rows = mix(documents, keep_rows=True, **options)
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def oracle_sql(weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most_epochs: int = MOST_EPOCHS) -> str:
    """The digest's rows in DuckDB."""
    return rf"""
with sized as (select doc_id, source, substr(md5(coalesce(text, '')), 1, 12) as digits, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size from documents),
sources as (select source, cast(sum(size) as bigint) as source_size, {list(weights)}[cast((row_number() over (order by source nulls last) - 1) % {len(weights)} as integer) + 1] as weight from sized group by source),
ranked as (select *, source_size * {float(most_epochs)} as most, {share} * sum(source_size) over () as pool, sum(weight) over () as weights from sources),
filled as (select *, pool - coalesce(sum(most) over w, 0) as rest, weights - coalesce(sum(weight) over w, 0) as sharers from ranked
  window w as (order by most / weight, source nulls last rows between unbounded preceding and 1 preceding)),
marked as (select *, most * sharers <= weight * rest as is_full from filled),
opened as (select rest as open_rest, sharers as open_sharers from marked where not is_full order by most / weight, source nulls last limit 1),
plan as (select source, source_size, case when is_full then most else cast(weight as double) * open_rest / open_sharers end as target from marked left join opened on true),
steps as (select *, case when source_size > 0 then cast(floor(round(target) / source_size) as bigint) else 0 end as epochs from plan),
placed as (select s.doc_id, s.size, s.digits, p.*, cast(round(target) as bigint) - epochs * source_size as rest, substr(md5(coalesce(cast(doc_id as varchar), 'null') || ':' || epochs || ':' || digits), 1, 15) as key from sized s join steps p on s.source is not distinct from p.source),
summed as (select *, coalesce(sum(size) over (partition by source order by key, doc_id, digits, size rows between unbounded preceding and 1 preceding), 0) as before from placed)
select doc_id, size, source_size, target, cast(epochs * size + greatest(0, least(size, rest - before)) as bigint) as taken from summed"""

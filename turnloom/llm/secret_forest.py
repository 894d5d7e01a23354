"""Secret scan with a random forest that removes false positives, in DataFrame expressions and Spark ML only.

Candidates are all runs of key characters in a word that have 16 characters and a digit, or that have 8 and are assigned
to a secret name ("name=value", "name: value", "\"name\":\"value\""), with the words around them (their nearest 64
characters). Features: length, shares of character classes, changes of class, how typical the character transitions are
of labelled secrets against labelled others, coverage by dictionary words (words of letters that the whole corpus uses
often), the path (`source`), and name and neighbouring words, by how often each stands beside labelled secrets and others.

The forest decides on every finding, labelled or not. Findings are dealt into folds by their value, so copies stay
together; a finding is scored by the forest trained on the other folds, and the transitions and neighbouring words of
that forest's rows, in training and in scoring, are counted without the scored fold and without the row's own. So
`score` beside `label` is a held-out measure, and no label reaches its own finding's answer.

Where no labels are given, rules label a part (vendor formats and assignments to secret names are secrets; numbers,
addresses, and digests next to a digest's name are not). The forest then sees none of the fixed patterns that these rules
read (NAMED): it learns from the values and the words around them, and judges also those that no rule labels.

Defined results: null and empty texts have no candidates; equal rows are scanned each, `at` (word) and `run` (place in
the word) tell apart the findings of a row; a null source is the path ""; where the other folds have no labelled secret
or no labelled other, the score is the share of secrets among all labels (null without labels, and not a secret); other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.session import written

#: Findings that a forest is trained on, taken by a hash of document and place; a class of fewer than RARE is taken whole.
TRAIN_ROWS, RARE = 50_000, 1_000
TREES, DEPTH = 24, 6
#: Parts of the findings, by value; each is judged by a forest of the others.
FOLDS = 4
# Names that announce secrets or harmless values, formats of vendors' keys, and paths of tests.
SECRET_NAMES = r"(?i)token|secret|passw(or)?d|passwd|\bpwd\b|api_?key|access_?key|private_?key|auth|bearer|credential"
OTHER_NAMES = r"(?i)sha-?(1|256|512)?\b|\bmd5\b|commit|digest|checksum|hash|uuid|etag|revision|\bid\b"
VENDORS = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}|^xox[abprs]-|^AIza[A-Za-z0-9_-]{35}|^sk-[A-Za-z0-9_-]{20}"
TEST_PATHS = r"(?i)test|example|sample|fixture|docs?/|\.md$"
#: A word is in the dictionary if the corpus has it so often, and so often among all its words of letters.
LEAST_USES, LEAST_RATE = 50, 1e-5
_RUN = r"[A-Za-z0-9+/_-]{16,}"
#: A name and what parts it from its value, if there are any, and the value.
_PAIR = r"(?:([A-Za-z][A-Za-z0-9_-]+)[\"'`]{0,2}[=:][\"'`]{0,2})?([A-Za-z0-9+/_-]{8,}={0,2})"
_NAMED_RUN = r"(?i)(?:token|secret|passw|passwd|pwd|key|auth|bearer|credential)[A-Za-z0-9_-]*[\"'`]{0,2}[=:][\"'`]{0,2}[A-Za-z0-9+/_-]{8,}"
_NAME_BEFORE = r"(?i)(?:token|secret|passw|passwd|pwd|key|auth|bearer|credential)[A-Za-z0-9_-]*[\"'`]{0,2}[=:]?$"
_SPACE = r"[ \t\r\n\f\x0B]+"
#: Of a neighbouring word at most so many characters are kept.
_NEAR = 64


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, path, at (word number), run (number in the word), before, before2, after, name (assigned to), value, and
    what the word is like (address, quoted)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.when(text.rlike(_RUN) | text.rlike(SECRET_NAMES), F.split(text, _SPACE)).otherwise(F.array().cast("array<string>"))
    rows = documents.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("path"), words.alias("words"))
    places = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: (F.get("words", i).rlike(_RUN) & F.get("words", i).rlike("[0-9]"))
        | F.get("words", i).rlike(_NAMED_RUN)
        | (F.get("words", i).rlike("[A-Za-z0-9+/_-]{8,}") & ((F.get("words", i - 1).rlike("^[=:]$") & F.get("words", i - 2).rlike(_NAME_BEFORE)) | F.get("words", i - 1).rlike(_NAME_BEFORE.replace("?$", "$")))),
    )
    found = rows.where(F.size("words") > 0).select("doc_id", "path", "words", F.explode(places).alias("at"))
    near = lambda d: F.coalesce(F.get("words", F.col("at") + d), F.lit(""))
    word = F.get("words", F.col("at"))
    pairs = F.arrays_zip(F.regexp_extract_all(word, F.lit(_PAIR), F.lit(1)).alias("name"), F.regexp_extract_all(word, F.lit(_PAIR), F.lit(2)).alias("value"))
    picked = found.select(
        "doc_id", "path", "at", F.right(near(-1), F.lit(_NEAR)).alias("before"), F.right(near(-2), F.lit(_NEAR)).alias("before2"), F.left(near(1), F.lit(_NEAR)).alias("after"),
        word.rlike("://|@").alias("address"), word.rlike("[\"'`]").alias("quoted"), F.posexplode(pairs).alias("run", "pair"),
    )
    spaced = F.when(F.col("run") > 0, "").when(F.col("before").rlike("^[=:]$"), F.col("before2")).when(F.col("before").rlike("[=:]$"), F.col("before"))
    name = F.when(F.col("pair.name") != "", F.col("pair.name")).otherwise(F.coalesce(spaced, F.lit("")))
    value = F.col("value")
    long = (F.length(F.regexp_replace(value, "=+$", "")) >= 16) & value.rlike("[0-9]")
    return picked.withColumn("name", name).withColumn("value", F.col("pair.value")).drop("pair").where(long | F.col("name").rlike(SECRET_NAMES))


def dictionary(documents: DataFrame, least: int = LEAST_USES, rate: float = LEAST_RATE) -> DataFrame:
    """dictionary_word: the words of 4 to 24 letters (a-z) that are at least `least` and a share `rate` of all such words."""
    words = F.split(F.translate(F.lower(F.coalesce(F.col("text"), F.lit(""))), ".,;:!?\n\t\r", "         "), " +")
    counted = documents.select(F.explode(words).alias("dictionary_word")).where(F.col("dictionary_word").rlike("^[a-z]{4,24}$")).groupBy("dictionary_word").count()
    counted = written(counted, "secret-words")
    total = counted.agg(F.sum("count")).first()[0] or 0
    return counted.where(F.col("count") >= max(least, rate * total)).select("dictionary_word")


def certain_labels(found: DataFrame) -> DataFrame:
    """found with `label`: 1 or 0 where a rule is sure, else null."""
    value, name = F.col("value"), F.col("name")
    vendor = value.rlike(VENDORS)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.length(value) >= 8)
    around = F.concat_ws(" ", "before2", "before")
    harmless = value.rlike(r"^[0-9_/+-]+$") | F.col("address") | (around.rlike(OTHER_NAMES) & ~name.rlike(SECRET_NAMES))
    label = F.when(vendor | (name.rlike(SECRET_NAMES) & mixed & ~F.col("address")), 1).when(harmless & ~name.rlike(SECRET_NAMES), 0)
    return found.withColumn("label", label)


def _share(pattern: str) -> Column:
    return F.regexp_count("value", F.lit(pattern)) / F.length("value")


def _parts(found: DataFrame) -> DataFrame:
    """A row for each two neighbouring characters of each finding's value and for each word of its name and neighbours."""
    starts = F.sequence(F.lit(1), F.length("value") - 1)
    pairs = F.transform(starts, lambda i: F.concat(F.lit("2"), F.substring(F.col("value"), i, F.lit(2))))
    around = F.lower(F.concat_ws(" ", "before2", "before", "name", "after"))
    words = F.transform(F.array_distinct(F.regexp_extract_all(around, F.lit(r"(\p{L}{2,})"), F.lit(1))), lambda w: F.concat(F.lit("w"), w))
    return found.select("finding", "label", "fold", F.explode(F.concat(pairs, words)).alias("part"))


def _odds(parts: DataFrame) -> DataFrame:
    """of, of_fold, odds: for each part of findings of a fold the log odds of a secret by the labels of all folds but this
    one and number i, for each i."""
    counts = parts.where("label is not null").groupBy("part", "fold").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    each = [F.sum(F.when(F.col("fold") == i, F.col(n)).otherwise(0)).alias(f"{n}_{i}") for i in range(FOLDS) for n in ("n1", "n0")]
    wide = counts.groupBy("part").agg(*each)

    def odds(own: int, left: int) -> Column:
        used = [i for i in range(FOLDS) if i not in (own, left)]
        return F.log((sum(F.col(f"n1_{i}") for i in used) + 1) / (sum(F.col(f"n0_{i}") for i in used) + 1))

    rows = [F.struct(F.lit(own).alias("of_fold"), F.array(*[odds(own, left) for left in range(FOLDS)]).alias("odds")) for own in range(FOLDS)]
    return wide.select(F.col("part").alias("of"), F.inline(F.array(*rows)))


#: Features that the rules of certain_labels() read.
NAMED = ("secret_name", "other_name", "secret_near", "vendor")
FEATURES = (
    "length", "digits", "capitals", "small", "marks", "hexadecimal", "changes", "transitions", "neighbours", "dictionary",
    "test_path", "quoted_word", "prose_near", *NAMED,
)


def with_features(found: DataFrame, documents: DataFrame) -> DataFrame:
    """found (with finding, fold and label) and the columns of FEATURES; transitions and neighbours are arrays with an
    entry for each fold that is left out."""
    around = F.concat_ws(" ", "before2", "before", "after")
    change = "|".join(("[0-9](?=[A-Za-z])", "[A-Za-z](?=[0-9])", "[a-z](?=[A-Z])", "[A-Z](?=[a-z])", "[+/_-](?=[A-Za-z0-9])"))
    plain = {
        "length": F.length("value"),
        "digits": _share("[0-9]"), "capitals": _share("[A-Z]"), "small": _share("[a-z]"), "marks": _share("[+/_=-]"), "hexadecimal": _share("[0-9a-f]"),
        "changes": _share(change), "test_path": F.col("path").rlike(TEST_PATHS),
        "secret_name": F.col("name").rlike(SECRET_NAMES), "other_name": F.col("name").rlike(OTHER_NAMES), 
        "quoted_word": F.col("quoted"), "secret_near": around.rlike(SECRET_NAMES), "prose_near": F.regexp_count(around, F.lit(r"\b\p{L}+\b")) / 3,
        "vendor": F.col("value").rlike(VENDORS),
    }
    parts = _parts(found)
    odds = written(_odds(parts), "secret-odds")
    known = parts.join(odds, (F.col("part") == F.col("of")) & (F.col("fold") == F.col("of_fold")), "left")
    pair = F.col("part").startswith("2")
    one = lambda i: F.coalesce(F.get("odds", F.lit(i)), F.lit(0.0))
    typical = known.groupBy("finding").agg(
        F.array(*[F.coalesce(F.avg(F.when(pair, one(i))), F.lit(0.0)) for i in range(FOLDS)]).alias("transitions"),
        F.array(*[F.coalesce(F.sum(F.when(~pair, one(i))), F.lit(0.0)) for i in range(FOLDS)]).alias("neighbours"),
    )
    runs = found.select("finding", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("([a-z]{4,24})"), F.lit(1))).alias("letters"))
    covered = runs.join(dictionary(documents), F.col("letters") == F.col("dictionary_word")).groupBy("finding").agg(F.sum(F.length("letters")).alias("covered"))
    measured = typical.withColumnRenamed("finding", "of").join(covered.withColumnRenamed("finding", "of2"), F.col("of") == F.col("of2"), "left").select("of", "transitions", "neighbours", "covered")
    out = found.select("*", *[c.cast("double").alias(n) for n, c in plain.items()])
    out = out.join(measured, F.col("finding") == F.col("of"), "left").drop("of")
    share = F.coalesce(F.col("covered") / F.length("value"), F.lit(0.0))
    return out.withColumn("dictionary", share).drop("covered")


def scanned(documents: DataFrame, labelled: DataFrame | None = None, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Every finding: doc_id, at, run, value, name, label (null if none is known), score, is_secret.

    labelled has doc_id, at, label and perhaps run of findings that somebody judged; without it certain_labels() are the
    labels.
    """
    found = certain_labels(candidates(documents))
    features = [f for f in FEATURES if labelled is not None or f not in NAMED]
    if labelled is not None:
        run = F.col("run") if "run" in labelled.columns else F.lit(None).cast("int")
        judged = labelled.select(F.col("doc_id").alias("of"), F.col("at").alias("of_at"), run.alias("of_run"), F.col("label").alias("judged"))
        same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("at") == F.col("of_at")) & (F.col("of_run").isNull() | (F.col("run") == F.col("of_run")))
        found = found.join(judged, same, "left").withColumn("label", F.col("judged")).drop("of", "of_at", "of_run", "judged")
    fold = F.pmod(F.crc32(F.col("value").cast("binary")), F.lit(FOLDS)).cast("int")
    found = written(found.withColumn("finding", F.monotonically_increasing_id()).withColumn("fold", fold), "secret-findings")
    counts = {(r[0], r[1]): r[2] for r in found.groupBy("fold", "label").count().collect()}
    total = lambda label, left=None: sum(n for (i, x), n in counts.items() if x == label and i != left)
    judged_by = [i for i in range(FOLDS) if total(1, i) and total(0, i)]
    # The other folds' findings get the share of secrets among all labels.
    all_labels = total(1) + total(0)
    plain = F.lit(total(1) / all_labels if all_labels else None).cast("double")
    scores = [found.where(~F.col("fold").isin(judged_by)).withColumn("score", plain)]
    rows = written(with_features(found, documents), "secret-features") if judged_by else found
    for i in judged_by:
        share = min(1.0, train_rows / (total(1, i) + total(0, i)))
        sampled = F.pmod(F.xxhash64("doc_id", "at", "run"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)
        rare = [label for label in (0, 1) if total(label, i) < RARE]
        seen = rows.withColumn("transitions", F.get("transitions", F.lit(i))).withColumn("neighbours", F.get("neighbours", F.lit(i)))
        forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=TREES, maxDepth=DEPTH, seed=5)
        model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), forest]).fit(seen.where(F.col("label").isNotNull() & (F.col("fold") != i) & (sampled | F.col("label").isin(rare))))
        scores.append(model.transform(seen.where(F.col("fold") == i)).withColumn("score", vector_to_array("probability")[1]))
    result = ["doc_id", "at", "run", "value", "name", "label", "score"]
    parts = [x.select(*result) for x in scores]
    return reduce(DataFrame.unionByName, parts).withColumn("is_secret", F.coalesce(F.col("score") >= 0.5, F.lit(False)))


def digest(result: DataFrame) -> DataFrame:
    """A result of scanned() without the values themselves: their SHA-256 and length."""
    return result.select(
        "doc_id", F.col("at").cast("long").alias("at"), F.col("run").cast("long").alias("run"), F.sha2("value", 256).alias("value_sha256"),
        F.length("value").cast("long").alias("length"), F.round("score", 6).alias("score"), "is_secret",
    )

"""Problem 2: quantities recorded in different units, converted to whole dollars or basis points.

A record's unit is read where it is stated. Where it is stated nowhere, a tree ensemble trained on the stated ones predicts
it from magnitude, source, category and neighbouring values; its probabilities are calibrated on held-out rows, confident
predictions are converted and the others go to review. Where the places of a record disagree, the ensemble decides among
what they say if it is confident; else the order of the places does. ``hidden_units`` measures it on units that were hidden.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import FeatureHasher, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingsift.functions.shared import written

#: The classifier is fitted on at most this many labelled rows (the least hashes of all), a third of them held out.
FIT_ROWS = 12_000
#: Predictions whose calibrated probability is at least this are converted.
CONFIDENT = 0.9
#: Bins of the calibration.
BINS = 10

# Spellings of units. A longer word wins over the bare currency.
UNITS = [
    ("bps", r"bps?|basis[ _]?points?"),
    ("percent", r"percent|pct"),
    ("fraction", r"fractions?"),
    ("usd_billions", r"billions?|bn|b"),
    ("usd_millions", r"millions?|mm|mn|m"),
    ("usd_thousands", r"thousands?|k"),
    ("usd", r"dollars?|usd|whole"),
]
FACTORS = {"bps": 1, "percent": 100, "fraction": 10_000, "usd": 1, "usd_thousands": 10**3, "usd_millions": 10**6, "usd_billions": 10**9}
NUMBER = r"(\d[\d,]*(?:\.\d+)?|\.\d+)"
FEATURES = ["size", "decimals", "grouped", "negative", "asked", "around", "around_decimals"]


def unit_of(text: Column) -> Column:
    """The unit that a phrase states, or null."""
    out = F.when(text.contains("%"), "percent")
    for unit, words in UNITS[:5]:
        out = out.when(text.rlike(rf"(?i)(?<![a-z])(?:{words})(?![a-z])"), unit)
    out = out.when(text.rlike(rf"(?i)(?<![a-z])(?:{UNITS[5][1]})(?![a-z])|(?<!\d)000s"), UNITS[5][0])
    return out.when(text.rlike(rf"(?i)(?<![a-z])(?:{UNITS[6][1]})(?![a-z])|\$"), UNITS[6][0])


def _said(*units: Column) -> dict[str, Column]:
    """What the places of a record state: the first of them, and all that differ."""
    return {"stated": F.coalesce(*units), "places": F.array_distinct(F.array_compact(F.array(*units)))}


def in_brackets(text: Column) -> Column:
    """What stands in parentheses, joined; null if nothing does."""
    return F.nullif(F.array_join(F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1)), " ; "), F.lit(""))


def _negative(text: Column) -> Column:
    return text.rlike(r"(?i)\([^)]*\d|(?:^|[^\w.])[-−–]\s*\$?\s*\d|(?<![a-z])loss")


def from_questions(questions: DataFrame) -> DataFrame:
    """One row per numeric question: the value, or if null the amount in the answer."""
    e = F.col("expected")
    answer = F.nullif(F.trim(e["answer"]), F.lit(""))
    number = F.regexp_extract(F.coalesce(answer, F.lit("")), NUMBER, 1)
    given = e["value"].isNotNull() & ~F.isnan(e["value"])
    raw = F.when(given, F.abs(e["value"]).cast("decimal(38,9)")).otherwise(F.regexp_replace(number, ",", "").try_cast("decimal(38,9)"))
    written_as = F.when(given, F.abs(e["value"]).cast("string")).otherwise(number)
    asked = F.regexp_extract("question", r"(?i)\(state[^()]* in ([^()]*)\)\s*$", 1)
    # an answer restates the value in its own unit; a value in another unit names that in expected.unit
    own, restated = _said(unit_of(e["unit"]), unit_of(answer), unit_of(asked)), _said(unit_of(answer), unit_of(e["unit"]), unit_of(asked))
    return questions.where(F.lower(F.trim("type")) == "numeric").select(
        F.col("id").alias("record_id"), F.lit("question").alias("origin"), raw.alias("raw"), written_as.alias("shown"),
        F.when(given, e["value"] < 0).otherwise(F.coalesce(_negative(answer), F.lit(False))).alias("negative"),
        *[F.when(given, own[k]).otherwise(restated[k]).alias(k) for k in own],
        F.regexp_extract("question", r"(?i) for (.*) at ", 1).alias("category"), F.lower(F.split(F.get(F.col("sources"), F.lit(0))["doc_id"], "_")[0]).alias("source"),
        F.lit("").alias("neighbours"),
    )


def from_blocks(blocks: DataFrame) -> DataFrame:
    """One row per table block with a row whose first cell begins with "total": that row's first value cell."""
    lines = F.split("text", "\n")
    total = F.get(F.filter(lines, lambda x: x.rlike(r"(?i)^\s*\|\s*total")), F.lit(0))
    cells = F.transform(F.split(F.regexp_replace(total, r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    cell = F.get(F.filter(F.slice(cells, 2, 1 << 20), lambda c: c.rlike(r"\d")), F.lit(0))
    number = F.regexp_extract("cell", NUMBER, 1)
    rows = F.filter(F.col("lines"), lambda x: x.rlike(r"^\s*\|"))
    notes = F.array_join(F.filter(F.col("lines"), lambda x: ~x.rlike(r"^\s*\|")), " ; ")
    noted = F.concat_ws(" ; ", F.nullif(F.regexp_extract(notes, r"(?i)\bin ([^.;()]*)", 1), F.lit("")), in_brackets(notes))
    header = F.get(rows, F.lit(0))
    found = blocks.where((F.lower(F.trim("kind")) == "table") & F.col("text").rlike(r"(?im)^\s*\|\s*total"))
    found = found.select("doc_id", "page_index", "block_no", "title", "units", lines.alias("lines"), F.get(cells, F.lit(0)).alias("label"), cell.alias("cell")).where("cell is not null")
    other = F.array_join(F.slice(F.filter(F.flatten(F.transform(rows, lambda r: F.slice(F.split(r, r"\|"), 3, 1))), lambda c: c.rlike(r"\d")), 2, 12), " ; ")
    said = _said(unit_of(F.nullif(F.regexp_replace("cell", r"\$", ""), F.lit(""))), unit_of(F.col("units")), unit_of(in_brackets(F.col("title"))), unit_of(in_brackets(header)), unit_of(noted), unit_of(F.col("cell")))
    return found.select(
        F.concat("doc_id", F.lit(":p"), "page_index", F.lit(":b"), "block_no").alias("record_id"), F.lit("block").alias("origin"),
        F.regexp_replace(number, ",", "").try_cast("decimal(38,9)").alias("raw"), number.alias("shown"), _negative(F.col("cell")).alias("negative"),
        *[v.alias(k) for k, v in said.items()],
        F.lower("label").alias("category"), F.lower(F.split("doc_id", "_")[0]).alias("source"), other.alias("neighbours"),
    )


def _featured(records: DataFrame) -> DataFrame:
    """Numbers that the classifier sees: magnitude and spelling of the value, and of the values around it."""
    near = F.transform(F.regexp_extract_all("neighbours", F.lit(NUMBER), F.lit(1)), lambda x: F.regexp_replace(x, ",", ""))
    logs = F.transform(near, lambda x: F.log10(F.greatest(x.try_cast("double"), F.lit(1e-4))))
    places = lambda x: F.length(F.regexp_extract(x, r"\.(\d+)", 1))
    mean = lambda a: F.when(F.size(a) > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)).otherwise(-9.0)
    return records.select(
        "*", F.log10(F.greatest(F.col("raw").cast("double"), F.lit(1e-4))).alias("size"), places(F.col("shown")).cast("double").alias("decimals"),
        F.col("shown").contains(",").cast("double").alias("grouped"), (F.col("origin") == "question").cast("double").alias("asked"),
        mean(logs).alias("around"), mean(F.transform(near, lambda x: places(x).cast("double"))).alias("around_decimals"),
    ).withColumn("negative", F.col("negative").cast("double")).fillna({"category": "", "source": ""})


def _predicted(records: DataFrame, labelled: DataFrame) -> DataFrame | None:
    """(record_id, guess, confidence) of ``records``, from a forest fitted on ``labelled``; None without two units."""
    sample = labelled.withColumn("key", F.xxhash64("record_id")).orderBy("key", "record_id").limit(FIT_ROWS)
    sample = written(_featured(sample), "labelled")
    if sample.select("stated").distinct().count() < 2:
        return None
    hasher = FeatureHasher(inputCols=["category", "source"], outputCol="hashed", numFeatures=64)
    gather = VectorAssembler(inputCols=[*FEATURES, "hashed"], outputCol="features")
    index = StringIndexer(inputCol="stated", outputCol="label", handleInvalid="skip").fit(sample)
    held = F.pmod(F.xxhash64(F.lit(1), F.col("record_id")), F.lit(3)) == 0
    forest = RandomForestClassifier(numTrees=20, maxDepth=8, seed=1, subsamplingRate=0.7)
    model = forest.fit(gather.transform(hasher.transform(index.transform(sample.where(~held)))))
    names = F.array(*[F.lit(x) for x in index.labels])

    def scored(df: DataFrame) -> DataFrame:
        out = model.transform(gather.transform(hasher.transform(df))).withColumn("p", vector_to_array("probability"))
        guess = F.get(names, F.col("prediction").cast("int"))
        top = F.array_max("p")
        return out.withColumn("guess", guess).withColumn("bin", F.least(F.floor(top * BINS), F.lit(BINS - 1)).cast("int"))

    # calibration by bins: how often a guess of this unit with this probability was right on held-out rows
    rates = scored(sample.where(held)).groupBy("guess", "bin").agg(((F.sum((F.col("guess") == F.col("stated")).cast("int")) + 1) / (F.count("*") + 2)).alias("confidence"))
    return scored(_featured(records)).join(F.broadcast(rates), ["guess", "bin"], "left").select("record_id", "guess", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))  # at most 7 units x BINS rows


def _records(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row per record with a number: of repeated rows that differ, the least."""
    records = from_questions(questions).unionByName(from_blocks(blocks)).where("raw is not null and record_id is not null")
    rest = [c for c in records.columns if c != "record_id"]
    once = records.groupBy("record_id").agg(F.min(F.struct(*rest)).alias("r")).select("record_id", *[F.col("r")[c].alias(c) for c in rest])
    # a bare currency sign disputes no scale
    return written(once.withColumn("disputed", F.size(F.filter("places", lambda u: u != "usd")) > 1), "quantities")


def quantities(questions: DataFrame, blocks: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """(record_id, origin, unit, status, confidence, measure, amount): one row per record that holds an amount.

    status is ``stated`` (the unit is named in the cell, answer, units, title, header, a line of the text or the question),
    ``predicted`` (by the classifier, with a calibrated probability of ``confident`` or more) or ``review`` (less; measure
    and amount are null). Where places state different units, the classifier chooses among these with such a probability,
    else the first place counts. Amounts are whole dollars (``usd``) or basis points (``bps``), rounded half up;
    parentheses, a minus and "loss" make them negative; one beyond the range of a bigint is null. Records without a number
    are left out, repeated rows count once; null kinds, types, texts and members of ``expected`` never match.
    """
    records = _records(questions, blocks)
    clear, unclear = records.where("stated is not null and not disputed"), records.where("stated is null or disputed")
    guesses = None if unclear.isEmpty() else _predicted(unclear, clear)
    if guesses is None:
        guesses = unclear.select("record_id", F.lit(None).cast("string").alias("guess"), F.lit(0.0).alias("confidence"))
    sure = F.col("confidence") >= confident
    unit = F.when(F.col("stated").isNull() | (sure & F.array_contains("places", F.col("guess"))), F.col("guess")).otherwise(F.col("stated"))
    status = F.when(F.col("stated").isNotNull(), "stated").when(sure, "predicted").otherwise("review")
    rest = unclear.join(guesses, "record_id").select(*unclear.columns, status.alias("status"), unit.alias("unit"), "confidence")
    out = clear.select("*", F.lit("stated").alias("status"), F.col("stated").alias("unit"), F.lit(1.0).alias("confidence")).unionByName(rest)
    factor = F.element_at(F.create_map(*[F.lit(x) for k, v in FACTORS.items() for x in (k, v)]), F.col("unit"))
    amount = F.round(F.col("raw") * factor.cast("decimal(12,0)"), 0) * F.when(F.col("negative"), -1).otherwise(1)
    kept = F.col("status") != "review"
    measure = F.when(F.col("unit").startswith("usd"), "usd").otherwise("bps")
    return out.select("record_id", "origin", "unit", "status", F.round("confidence", 6).alias("confidence"), F.when(kept, measure).alias("measure"), F.when(kept, amount.try_cast("bigint")).alias("amount"))


def hidden_units(questions: DataFrame, blocks: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """(unit, records, right, accuracy, converted, converted_right, calibration, review_share) by stated unit: the units of a
    hashed fifth of the undisputed records are hidden from the classifier and predicted. ``calibration`` is the mean
    confidence of the converted ones less their accuracy (null where none is converted)."""
    stated = _records(questions, blocks).where("stated is not null and not disputed")
    hidden = F.pmod(F.xxhash64(F.lit(5), F.col("record_id")), F.lit(5)) == 0
    guesses = _predicted(stated.where(hidden), stated.where(~hidden))
    if guesses is None:
        guesses = stated.where("false").select("record_id", F.lit("").alias("guess"), F.lit(0.0).alias("confidence"))
    rows = stated.where(hidden).join(guesses, "record_id").withColumn("right", F.col("guess") == F.col("stated")).withColumn("sure", F.col("confidence") >= confident)
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    both = F.count_if(F.col("sure") & F.col("right"))
    return rows.groupBy(F.col("stated").alias("unit")).agg(
        F.count("*").alias("records"), F.count_if("right").alias("right"), share(F.count_if("right"), F.count("*")).alias("accuracy"), F.count_if("sure").alias("converted"), both.alias("converted_right"),
        F.round(F.avg(F.when(F.col("sure"), F.col("confidence"))) - F.try_divide(both.cast("double"), F.count_if("sure").cast("double")), 6).alias("calibration"), share(F.count_if(~F.col("sure")), F.count("*")).alias("review_share"),
    )

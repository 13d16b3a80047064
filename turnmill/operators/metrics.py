"""Evaluation of prediction tables.  A metric is a function DataFrame -> DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnmill import catalog
from turnmill.functions.text import col


def first_argmax(scores: Column | str) -> Column:
    """0-based position of the largest score; the first wins a tie."""
    s = col(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def hierarchy(df: DataFrame) -> DataFrame:
    """Fixed table subject -> subcategory -> category (57 rows)."""
    group_of = {sub: cat for cat, subs in catalog.CATEGORIES.items() for sub in subs}
    rows = [(s, sub, group_of[sub]) for s, sub in catalog.SUBJECTS.items()]
    return df.sparkSession.createDataFrame(rows, "subject string, subcategory string, category string")


def hierarchical_accuracy(predictions: DataFrame) -> DataFrame:
    """``(level, name, n, accuracy)`` in percent: subjects, subcategories, categories, and the average.

    Groups are micro averages; ``average`` is the mean over the subjects present.  The correct counts
    are combined per subject first (at most 57 rows), so no group is ever collected.
    """
    per = predictions.groupBy("subject").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("pred") == F.col("gt")).cast("long")).alias("_hit"))
    per = per.join(F.broadcast(hierarchy(predictions)), "subject")
    level = F.when(F.col("subject").isNotNull(), "subject").when(
        F.col("subcategory").isNotNull(), "subcategory").otherwise("category")
    sets = per.groupingSets([["subject"], ["subcategory"], ["category"]], "subject", "subcategory", "category").agg(
        F.sum("_n").alias("n"), F.sum("_hit").alias("_hit"))
    groups = sets.select(level.alias("level"), F.coalesce("subject", "subcategory", "category").alias("name"), "n",
                         (F.col("_hit") / F.col("n") * 100).alias("accuracy"))
    macro = per.agg(F.sum("_n").alias("n"), F.avg(F.col("_hit") / F.col("_n") * 100).alias("accuracy")).select(
        F.lit("average").alias("level"), F.lit("average").alias("name"), "n", "accuracy")
    return groups.unionByName(macro)


def circular_hits(predictions: DataFrame, answers: DataFrame, base: int = 1_000_000) -> DataFrame:
    """``(question, hit)``: 1 only if every variant's first A-D run equals that variant's answer.

    Variants of a question share ``index % base``; the question reports under its own row
    (``index < base``).
    """
    question, none = (F.col("index") % base).alias("question"), F.lit(None).cast("string")
    said = F.coalesce(F.regexp_extract(F.col("prediction"), "([A-D]+)", 1), F.lit(""))
    # Dealt by question once: variants are matched and questions judged where they are.
    both = predictions.select(question, "index", said.alias("_said"), none.alias("_answer")).unionByName(
        answers.select(question, "index", none.alias("_said"), F.col("answer").alias("_answer"))).repartition("question")
    matched = both.groupBy("question", "index").agg(F.min("_said").alias("_low"), F.max("_said").alias("_high"), F.max("_answer").alias("_answer"))
    hit = (F.col("_low") == F.col("_answer")) & (F.col("_high") == F.col("_answer"))
    per = matched.where("_low is not null and _answer is not null").groupBy("question").agg(
        F.min(hit.cast("int")).alias("hit"), F.bool_or(F.col("index") < base).alias("_main"))
    return per.where("_main").select("question", "hit")


def circular_accuracy(predictions: DataFrame, questions: DataFrame, *, base: int = 1_000_000) -> DataFrame:
    """``(ability, n, accuracy)`` overall and per l2-category (or category), with short ability names."""
    group = "l2-category" if "l2-category" in questions.columns else "category"
    hits = circular_hits(predictions, questions, base)
    main = questions.where(F.col("index") < base).select(
        F.col("index").alias("question"), F.col(group).alias("_group"))
    short = F.col("_group")
    for name, abbr in catalog.ABILITY_NAMES.items():
        short = F.when(F.col("_group") == name, F.lit(abbr)).otherwise(short)
    graded = hits.join(main, "question").withColumn("ability", short)
    per = graded.groupBy("ability").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("_hit"))
    overall = per.agg(F.sum("n").alias("n"), F.sum("_hit").alias("_hit")).select(
        F.lit("Average").alias("ability"), "n", "_hit")
    return per.select("ability", "n", "_hit").unionByName(overall).select(
        "ability", "n", (F.col("_hit") / F.col("n")).alias("accuracy"))


def box_iou(a: Column, b: Column) -> Column:
    """Intersection over union of inclusive pixel boxes (xyxy arrays)."""
    g = lambda v, i: F.get(v, F.lit(i))
    span = lambda lo, hi: F.greatest(hi - lo + 1, F.lit(0))
    inter = span(F.greatest(g(a, 0), g(b, 0)), F.least(g(a, 2), g(b, 2))) * \
        span(F.greatest(g(a, 1), g(b, 1)), F.least(g(a, 3), g(b, 3)))
    area = lambda v: (g(v, 2) - g(v, 0) + 1) * (g(v, 3) - g(v, 1) + 1)
    return inter / (area(a) + area(b) - inter)


def answer_box(text: Column | str) -> Column:
    """Integers of an answer; a box only if there are exactly four."""
    found = F.regexp_extract_all(col(text), F.lit(r"(\d+)"), F.lit(1))
    return F.when(F.size(found) == 4, F.transform(found, lambda v: v.cast("int")))


def iou_accuracy(answers: DataFrame, *, by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """Share of answers whose box overlaps ``box`` by more than ``threshold``; malformed ones count as wrong."""
    said = answer_box("ans")
    hit = F.coalesce(box_iou(said, F.col("box")) > threshold, F.lit(False))
    return answers.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(said.isNull()).alias("n_malformed"),
        (F.count_if(hit) / F.count(F.lit(1))).alias("accuracy"))


def reward_accuracy(scores: DataFrame, by: str = "ds_name") -> DataFrame:
    """Per data set: share of pairs ranked right, and mean scores."""
    return scores.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col("chosen") > F.col("rejected")).cast("double")).alias("accuracy"),
        F.avg("chosen").alias("chosen_score"), F.avg("rejected").alias("rejected_score"))

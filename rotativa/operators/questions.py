"""A bank of typed questions put to every article, and its checked answers.

A question is a row of data: what kind of answer it takes and which values are allowed. Kinds are
``choice`` (one of ``options``), ``number`` (from ``low`` to ``high``), ``flag`` (yes or no) and ``impact`` (a sign
and a degree from 0 to ``high``, as in ``+2`` or ``-1``; 0 has no sign).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YES, NO = ("si", "sí", "yes", "true", "1"), ("no", "false", "0")


@dataclass(frozen=True)
class Question:
    id: str
    kind: str
    text: str = ""
    options: tuple[str, ...] = field(default=())
    low: float = 0.0
    high: float = 100.0

    def __post_init__(self):
        if self.kind not in ("choice", "number", "flag", "impact") or (self.kind == "choice") != bool(self.options):
            raise ValueError(f"question {self.id}: unknown kind, or options missing or unused")


def bank_column(bank: Sequence[Question]) -> Column:
    """The bank as an array of structs, part of every row's plan and not a table to join."""
    if len({q.id for q in bank}) < len(bank):
        raise ValueError("two questions have the same id")

    def one(q: Question) -> Column:
        options = F.array(*map(F.lit, q.options)).cast("array<string>")
        return F.struct(
            F.lit(q.id).alias("id"), F.lit(q.kind).alias("kind"), F.lit(q.text).alias("text"), options.alias("options"),
            F.lit(float(q.low)).alias("low"), F.lit(float(q.high)).alias("high"),
        )

    return F.array(*map(one, bank))


def with_questions(df: DataFrame, bank: Sequence[Question], fields: dict[str, str], out: str = "questions") -> DataFrame:
    """Add an array of (id, prompt), one per question: its text, what may be answered, and the article's fields.

    ``{name}`` in a question's text is replaced by the column that ``fields`` gives for the name; missing values read "unknown".
    """

    def asked(q: Column) -> Column:
        text = q["text"]
        for name, column in fields.items():
            text = F.replace(text, F.lit(f"{{{name}}}"), F.coalesce(F.col(column).cast("string"), F.lit("unknown")))
        span = F.concat(q["low"].cast("string"), F.lit(" .. "), q["high"].cast("string"))
        allowed = (
            F.when(q["kind"] == "choice", F.array_join(q["options"], " | "))
            .when(q["kind"] == "number", span)
            .when(q["kind"] == "impact", F.concat(F.lit("+/- "), span))
            .otherwise(F.lit(f"{YES[0]} | {NO[0]}"))
        )
        return F.struct(q["id"].alias("id"), F.concat(text, F.lit(" ["), allowed, F.lit("]")).alias("prompt"))

    return df.withColumn(out, F.transform(bank_column(bank), asked))


def checked_answers(df: DataFrame, bank: Sequence[Question], keys: list[str], response: str = "response") -> DataFrame:
    """(keys..., question, kind, raw, value, label, violation): one row per row and question.

    ``response`` is a JSON object of answers by question id. ``value`` is the number, the flag as 1 or 0, or the
    signed impact; ``label`` the choice, or the impact's sign. ``violation`` is ``unreadable`` where the
    response is no JSON object, ``missing``, ``type`` (no number, no such choice) or ``range``; then value and label are null. Case and outer
    blanks of an answer don't matter.
    """
    answers = F.from_json(F.col(response).cast("string"), "map<string,string>")
    each = df.select(*keys, answers.alias("_answers"), F.explode(bank_column(bank)).alias("q"))
    raw = F.try_element_at("_answers", F.col("q.id"))
    each = each.withColumn("raw", raw).withColumn("_low", F.lower(F.trim("raw")))
    number = F.regexp_replace("_low", r"^\+", "").try_cast("double")
    options = F.transform("q.options", lambda o: F.lower(o))
    at = F.array_position(options, F.col("_low"))
    kind = F.col("q.kind")
    yes, no = F.col("_low").isin(*YES), F.col("_low").isin(*NO)
    value = F.when(kind == "flag", F.when(yes, 1.0).when(no, 0.0)).when(kind != "choice", F.when(~F.isnan(number), number))
    size = F.when(kind == "impact", F.abs(F.col("_value"))).otherwise(F.col("_value"))
    typed = each.withColumns({"_value": value, "_label": F.when((kind == "choice") & (at > 0), F.element_at("q.options", F.nullif(at, F.lit(0)).cast("int")))})
    wrong = (
        F.when(F.col("_answers").isNull(), "unreadable")
        .when(F.col("raw").isNull() | (F.col("_low") == ""), "missing")
        .when(F.col("_value").isNull() & F.col("_label").isNull(), "type")
        .when(kind.isin("number", "impact") & ~size.between(F.col("q.low"), F.col("q.high")), "range")
    )
    judged = typed.withColumn("violation", wrong)
    good = F.col("violation").isNull()
    sign = F.when(F.col("_value") > 0, "positivo").when(F.col("_value") < 0, "negativo").otherwise("neutro")
    label = F.when(kind == "impact", sign).otherwise(F.col("_label"))
    return judged.select(
        *keys, F.col("q.id").alias("question"), kind.alias("kind"), "raw",
        F.when(good, F.col("_value")).alias("value"), F.when(good, label).alias("label"), "violation",
    )


def answer_summary(answers: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., question, n, valid, avg_value, labels): per group and question, with counts of each label as a map.

    Counts per label come first, so a task sends a row per group, question and label.
    """
    good = F.col("violation").isNull()
    parts = answers.groupBy(*keys, "question", "label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(good).alias("valid"), F.sum("value").alias("sum"), F.count("value").alias("values")
    )
    labels = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n")))))
    return parts.groupBy(*keys, "question").agg(
        F.sum("n").alias("n"), F.sum("valid").alias("valid"), F.try_divide(F.sum("sum"), F.sum("values")).alias("avg_value"), labels.alias("labels")
    )

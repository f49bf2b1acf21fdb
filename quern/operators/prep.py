"""Training examples and prompts from conversations and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "How to answer:\n* After each statement put the number of the source it rests on, as [N].\n* Where the sources leave the question open, answer that they do.\n* State nothing that no source says.\n\n"


def _turns(rows: DataFrame, group: str, order: str, *fields: str) -> DataFrame:
    return rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, *fields))).alias("m"))


def chat_prompt(rows: DataFrame, group: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(group, prompt): ``role: text`` lines in order.  A conversation is gathered whole: it is one row."""
    return _turns(rows, group, order, role, text).select(group, F.array_join(F.transform("m", lambda x: F.concat(x[role], F.lit(": "), x[text])), "\n").alias("prompt"))


def message_pairs(rows: DataFrame, group: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(group, input, output): the user's and the assistant's turns, each joined by line breaks."""
    m = _turns(rows, group, order, role, text)
    said = lambda who: F.array_join(F.transform(F.filter("m", lambda x: x[role] == who), lambda x: x[text]), "\n")
    return m.select(group, said("user").alias("input"), said("assistant").alias("output"))


def best_answers(questions: DataFrame, answers: DataFrame, key: str, accepted: str, score: str, order: str) -> DataFrame:
    """Each question with its best answer: the accepted, else the highest score, else the first."""
    best = answers.groupBy(key).agg(F.max(F.struct(F.col(accepted).cast("int").alias("x"), F.col(score).alias("s"), (-F.col(order)).alias("o"), F.struct(*answers.columns).alias("row"))).alias("b"))
    return questions.join(best.select(F.col(key), F.col("b.row").alias("answer")), key)


def first_of(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns])


def converted(records: DataFrame) -> DataFrame:
    """(input, output) of instruction, input/output or text records."""
    has = lambda c: F.col(c) if c in records.columns else F.lit(None).cast("string")
    asked = F.when((has("input") != "") & (has("instruction") != ""), F.concat(has("instruction"), F.lit("\n"), has("input"))).otherwise(first_of(has("instruction"), has("input"), has("text")))
    return records.select("*", asked.alias("model_input"), first_of(has("output"), has("response"), has("text")).alias("model_output"))


def invalid_records(records: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """One row: records, and for each required field how many are null or empty."""
    return records.agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.coalesce(F.col(c), F.lit("")) == "").alias(f"missing_{c}") for c in required])


def grounded_prompt(results: DataFrame, group: str, order: str, title: str, url: str, body: str, date: Column | None = None, most: int = 1200, persona: str = "Answer from the numbered sources below.\n") -> DataFrame:
    """(group, prompt): numbered source blocks after fixed instructions."""
    dated = F.concat(F.lit(" ("), date, F.lit(")")) if date is not None else F.lit(None).cast("string")
    rows = results.select(group, F.struct(F.col(order).alias("o"), F.col(title).alias("t"), F.coalesce(dated, F.lit("")).alias("d"), F.col(url).alias("u"), F.substring(body, 1, most).alias("b")).alias("r"))
    ordered = rows.groupBy(group).agg(F.array_sort(F.collect_list("r")).alias("r"))
    block = F.transform("r", lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), x["t"], x["d"], F.lit("\nURL: "), x["u"], F.lit("\n"), x["b"]))
    return ordered.select(group, F.concat(F.lit(persona + RULES + "SOURCES:\n"), F.trim(F.array_join(block, "\n\n")), F.lit("\n")).alias("prompt"))


def citations(answers: DataFrame, results: DataFrame, group: str, answer: str, order: str) -> DataFrame:
    """The results that each answer cites as [N], once each; numbers without a result are left out."""
    cited = answers.select(group, F.explode(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int")))).alias("index"))
    ranked = results.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*results.columns).alias("row")))).alias("r"))
    numbered = ranked.select(group, F.posexplode("r").alias("p", "x")).select(group, (F.col("p") + 1).alias("index"), F.col("x.row").alias("row"))
    return cited.join(numbered, [group, "index"])

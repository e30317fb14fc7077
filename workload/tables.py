"""The frames that the queries make of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triptych.operators.triples import gather_triples


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four neighbouring documents are a source and its candidates A, B, C."""
    docs = table(spark, sf_dir, "documents")
    return gather_triples(
        docs, {"seg_id": F.expr("doc_id div 4")}, F.col("doc_id") % 4, F.col("text"),
        {"lang": F.col("lang"), "source": F.col("source")})


def conversation_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four neighbouring turns; the last ones of a conversation are incomplete."""
    turns = table(spark, sf_dir, "conversations")
    return gather_triples(turns, {"conv_id": F.col("conv_id"), "part": F.expr("turn div 4")},
                          F.col("turn") % 4, F.col("text"))


def _object(**fields: Column) -> Column:
    parts: list[Column] = []
    for key, value in fields.items():
        parts += [F.lit(("{" if not parts else ", ") + f'"{key}": "'), value, F.lit('"')]
    return F.concat(*parts, F.lit("}"))


def event_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as model attempts: twelve in a row are four for each of three stages."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    events = events.select("event_id", "event_type", k.alias("k"))
    stage = F.expr("event_id % 12 div 4")
    kind, number = F.col("event_type"), F.col("k").cast("string")

    def numbered(prefix: str) -> Column:
        return F.concat(F.lit(prefix), number)

    german = F.when(F.col("k") % 11 == 0, _object(target_A=numbered("a"))).otherwise(
        _object(english_sentence=F.concat(kind, F.lit(" "), number), target_A=numbered("a"),
                target_B=numbered("b"), target_C=numbered("c")))
    identification = F.when(F.col("k") % 7 == 0, _object(urdu_idiom_native=kind)).otherwise(
        _object(urdu_idiom_native=kind,
                urdu_idiom_roman=F.when(F.col("k") % 5 == 0, F.lit("")).otherwise(numbered("r"))))
    urdu = _object(**{f"target_{c}_{script}": numbered(f"{c}{script[0]}")
                      for script in ("native", "roman") for c in "ABC"})
    body = F.when(stage == 0, german).when(stage == 1, identification).otherwise(urdu)
    wrapped = (F.when(F.col("k") % 6 == 0, body)
               .when(F.col("k") % 6 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
               .when(F.col("k") % 6 == 2, F.concat(F.lit("Here it is:\n"), body, F.lit("\n")))
               .when(F.col("k") % 6 == 3, F.concat(body, F.lit(" Hope this helps!")))
               .when(F.col("k") % 6 == 4, F.lit("{}")))
    answered = wrapped.isNotNull()
    return events.select(
        "event_id",
        F.when(stage == 0, "german").when(stage == 1, "urdu_ident").otherwise("urdu_trans")
        .alias("stage"),
        F.expr("event_id div 12").alias("idiom_id"),
        (F.col("event_id") % 4 + 1).cast("int").alias("attempt"),
        wrapped.alias("response"),
        F.when(answered, F.col("k")).alias("prompt_tokens"),
        F.when(answered, 99 - F.col("k")).alias("completion_tokens"))


def part_idioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as base idioms."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("idiom_id"), F.col("p_name").alias("idiom"),
        F.col("p_type").alias("meaning"), F.col("p_brand").alias("german_idiom"))

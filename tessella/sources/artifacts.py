"""Recorded run artifacts as tables: archives, search-universe summaries, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = ("name", "expression", "hypothesis", "expected_sign", "reasoning", "interaction_type", "theme_a", "theme_b", "author")
PROPOSAL = T.StructType([T.StructField(n, T.StringType()) for n in _TEXT])
EVALUATED = T.StructType([*PROPOSAL.fields, T.StructField("generation", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in ("fmb_tstat", "ls_alpha", "ls_talpha", "ls_sharpe", "coverage")], T.StructField("error", T.StringType())])
NOTE = T.StructType([T.StructField("generation", T.LongType()), T.StructField("target_name", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("score", T.LongType()), T.StructField("rationale", T.StringType())])
ARCHIVE = T.StructType([T.StructField("pair", T.StringType()), T.StructField("evaluated", T.ArrayType(EVALUATED)), T.StructField("considered", T.ArrayType(PROPOSAL)), T.StructField("critic_notes", T.ArrayType(NOTE))])
TOTALS = T.StructType([T.StructField(n, T.LongType()) for n in ("experiments", "considered_proposals", "unique_considered_expressions", "evaluated_tests", "evaluation_errors", "invalid_results", "wrong_sign", "weak_signals", "significant_correct_sign", "validation_rejections")])
UNIVERSE = T.StructType([T.StructField("schema_version", T.StringType()), T.StructField("totals", TOTALS), T.StructField("validation_rejection_codes", T.MapType(T.StringType(), T.LongType()))])
DIAGNOSTIC = T.StructType([*[T.StructField(n, T.StringType()) for n in ("severity", "code", "message", "proposal_name")], T.StructField("generation", T.LongType())])


def read_json(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    """Whole-file JSON documents, a row each, with their path."""
    return spark.read.schema(schema).json(paths, multiLine=True).withColumn("source", F.input_file_name())


def read_lines(spark: SparkSession, paths, schema: T.StructType = DIAGNOSTIC) -> DataFrame:
    """JSON lines; blank ones are skipped."""
    return spark.read.schema(schema).json(paths).dropna("all")


def exploded(archives: DataFrame, part: str) -> DataFrame:
    """Rows of evaluated, considered or critic_notes, with pair and source."""
    return archives.select("pair", "source", F.explode(part).alias("__r")).select("pair", "source", "__r.*")


def write_strict(df: DataFrame, path: str) -> None:
    """JSON lines in which NaN and infinities are null."""
    def finite(f: T.StructField):
        c = F.col(f"`{f.name}`")
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c

    df.select(*map(finite, df.schema.fields)).write.json(path, ignoreNullFields=False)


def universe_totals(documents: DataFrame, run) -> DataFrame:
    """Totals by run (a column of `source`), and over all (run NULL)."""
    t = documents.select(run.alias("run"), "totals.*")
    return t.rollup("run").agg(*[F.sum(f.name).alias(f.name) for f in TOTALS.fields])

"""JSON artifacts of runs: verdict and gate files, run registry, artifact index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.sources.tables import list_files

# Fixed file-name format: {dataset}__{stage}[__retryN]__{gate|verdict}.json
RECORD_NAME = (r"^(.+?)__(cleaning|analysis|cross_validation)(?:__(retry[0-9]+))?__(gate|verdict)"
               r"\.json$")
CHECK = ("array<struct<name:string,passed:boolean,severity:string,category:string,detail:string,"
         "ref:string>>")
GATE_SCHEMA = ("status string, quality_score double, quality_breakdown map<string,double>, "
               "_corrupt_record string")
VERDICT_SCHEMA = (f"structural_checks {CHECK}, content_checks {CHECK}, plot_checks {CHECK}, "
                  f"claim_checks {CHECK}, evaluators_ran map<string,boolean>, _corrupt_record string")
RUN_SCHEMA = ("batch_id string, pipeline_mode string, model string, timestamp string, "
              "file_count int, run_config struct<run_label:string>, _corrupt_record string")
# Fixed folders and endings of the artifact types.
ARTIFACT_TYPES = {
    "report": r"__report\.md$", "figure": r"\.png$", "verdict": r"__verdict\.json$",
    "gate": r"__gate\.json$", "profile": r"__data_profile\.json$",
    "analysis": r"analysis_summary\.json$", "cleaning": r"cleaning_summary\.json$",
    "table": r"\.(parquet|csv)$",
}


def _named(df: DataFrame) -> DataFrame:
    name = F.col("_metadata.file_name")

    def part(i: int) -> Column:
        return F.regexp_extract(name, RECORD_NAME, i)
    return df.select("*", part(1).alias("dataset"), part(2).alias("stage"), part(3).alias(
        "attempt_label"), F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3).alias("run_id"))


def unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """Gate and verdict files that are not JSON or whose name does not follow the format."""
    def scan(kind: str, schema: str, column: str) -> DataFrame:
        raw = spark.read.schema(schema).option("multiLine", True).option(
            "recursiveFileLookup", True).option("pathGlobFilter", f"*__{kind}.json").json(folder)
        return _named(raw.select(column, "_corrupt_record", "_metadata")).select(
            F.col("_metadata.file_path").alias("path"), F.lit(kind).alias("kind"),
            F.when(F.col("_corrupt_record").isNotNull() & F.col(column).isNull(), "not JSON").when(
                F.col("dataset") == "", "unknown name").alias("problem"))
    return scan("gate", GATE_SCHEMA, "status").unionByName(
        scan("verdict", VERDICT_SCHEMA, "evaluators_ran")).filter("problem is not null")


def read_gates(spark: SparkSession, folder: str) -> DataFrame:
    """Gate records of all runs; ``unreadable`` lists the files that give none."""
    raw = spark.read.schema(GATE_SCHEMA).option("multiLine", True).option(
        "recursiveFileLookup", True).option("pathGlobFilter", "*__gate.json").json(folder)
    return _named(raw).filter("_corrupt_record is null and dataset <> ''").drop("_corrupt_record")


def read_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict records of all runs, all check lists united in ``checks``."""
    raw = spark.read.schema(VERDICT_SCHEMA).option("multiLine", True).option(
        "recursiveFileLookup", True).option("pathGlobFilter", "*__verdict.json").json(folder)
    empty = F.array().cast(CHECK)
    lists = [F.coalesce(c, empty) for c in ("structural_checks", "content_checks", "plot_checks",
                                            "claim_checks")]
    return _named(raw).filter("_corrupt_record is null and dataset <> ''").select(
        "run_id", "dataset", "stage", "attempt_label", "evaluators_ran", F.concat(*lists).alias("checks"))


def run_registry(spark: SparkSession, folder: str) -> DataFrame:
    """One row per run folder from ``judge_input.json``, else from its manifest, by time."""
    def scan(pattern: str) -> DataFrame:
        raw = spark.read.schema(RUN_SCHEMA).option("multiLine", True).option(
            "recursiveFileLookup", True).option("pathGlobFilter", pattern).json(folder)
        return raw.select("*", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias(
            "run_id")).filter("_corrupt_record is null").drop("_corrupt_record")
    cols = ["batch_id", "pipeline_mode", "model", "timestamp", "file_count"]

    def flat(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.max(F.struct(
            "timestamp", *[c for c in cols if c != "timestamp"],
            F.col("run_config.run_label").alias("run_label"))).alias(tag))
    main = flat(scan("judge_input.json"), "a")
    spare = flat(scan("manifest_*.json"), "b")
    out = main.join(spare, "run_id", "full")
    return out.select("run_id", *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in [*cols, "run_label"]]
                      ).orderBy("timestamp", "run_id")


def artifact_type(path: Column) -> Column:
    return F.coalesce(*[F.when(path.rlike(p), t) for t, p in ARTIFACT_TYPES.items()], F.lit("other"))


def artifact_index(spark: SparkSession, folder: str) -> DataFrame:
    """Per run and dataset: number of artifacts of each type, from paths alone."""
    files = list_files(spark, f"{folder}/*/*", "*")
    run = F.element_at(F.split("path", "/"), -3)
    dataset = F.split(F.col("name"), "__")[0]
    return files.select(run.alias("run_id"), dataset.alias("dataset"), artifact_type(
        F.col("path")).alias("type")).groupBy("run_id", "dataset").pivot(
        "type", [*ARTIFACT_TYPES, "other"]).count().na.fill(0)

"""Stored tables: lesion CSVs, settings and histories, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.ids import punch_of_section

LESION_CSV = (
    "Lesion_ID int, Coagulation_Width_um double, Ablation_Diameter_um double, Has_Ablation boolean, "
    "Lesion_Diameter_um double, Coagulation_Area_um2 double, Ablation_Area_um2 double, "
    "Center_X_px double, Center_Y_px double, Center_X double, Center_Y double, Touches_Edge boolean, Dist_To_Edge_um double")
HISTORY = (
    "patience int, epochs array<struct<epoch:int, train_loss:double, val_loss:double, val_accuracy:double, checkpoint:string>>, "
    "best_epoch int, best_val_loss double, epochs_no_improve int, best_model_path string, last_checkpoint string, resumed_from string")
CLASS_WEIGHTS = "method string, class_names array<string>, weights array<double>"
FILTER_PARAMETERS = "chosen struct<tau:double, d_um:double, f1:double, precision:double, recall:double, macro_dice:double>"


def section_of_path(path):
    return F.regexp_extract(path, r"/([^/]+)/csv/[^/]+$", 1)


def csv_by_name(spark: SparkSession, paths: str, schema: str) -> DataFrame:
    """Headed CSV files matched to the schema by column name, whatever their order; with ``_path``.

    Absent columns are null, unknown ones are left out, names compare without
    case.  Files are small (one section each); the few different headers are
    looked up first, and each is parsed with its own column order.
    """
    files = spark.read.text(paths, wholetext=True).select(
        F.col("_metadata.file_path").alias("_path"), F.split("value", "\r?\n").alias("_lines")).where(F.trim(F.col("_lines")[0]) != "")
    want = {part.split()[0]: part.split()[1] for part in schema.split(", ")}
    out = spark.createDataFrame([], f"{schema}, _path string")
    for head in sorted(r[0] for r in files.select(F.col("_lines")[0]).distinct().collect()):
        names = [n.strip().strip('"').lower() for n in head.lstrip("\ufeff").split(",")]
        lines = files.where(F.col("_lines")[0] == head).select(
            "_path", F.explode(F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))).alias("_line")).where(F.trim("_line") != "")
        parsed = lines.select("_path", F.from_csv("_line", ", ".join(f"`c{i}` string" for i in range(len(names)))).alias("_c"))
        columns = [(F.col(f"_c.c{names.index(n.lower())}") if n.lower() in names else F.lit(None)).try_cast(t).alias(n) for n, t in want.items()]
        out = out.unionByName(parsed.select(*columns, "_path"))
    return out


def lesion_summaries(spark: SparkSession, root: str) -> DataFrame:
    """All ``*/csv/lesion_summary.csv`` below ``root``, with section and punch; none is an error."""
    rows = csv_by_name(spark, f"{root}/*/csv/lesion_summary.csv", LESION_CSV)
    rows = rows.withColumn("section_id", section_of_path(F.col("_path"))).drop("_path")
    return snake_case(rows).withColumn("punch_id", punch_of_section(F.col("section_id")))


def written_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The rounded rows that ``sinks.write_lesions`` stored below ``path``, in the same form."""
    rows = csv_by_name(spark, f"{path}/lesion_summary/section_id=*/*.csv", LESION_CSV)
    section = F.url_decode(F.regexp_extract("_path", "/section_id=([^/]+)/[^/]+$", 1))
    return snake_case(rows.withColumn("section_id", section).drop("_path")).withColumn("punch_id", punch_of_section(F.col("section_id")))


def snake_case(rows: DataFrame) -> DataFrame:
    """Lower-case names; pixel centres, or the plain centre columns where they are missing."""
    out = rows.toDF(*[c.lower() for c in rows.columns])
    for axis in ("x", "y"):
        have = [c for c in (f"center_{axis}_px", f"center_{axis}") if c in out.columns]
        out = out.withColumn(f"center_{axis}", F.coalesce(*have)).drop(f"center_{axis}_px")
    return out


def class_weights(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(CLASS_WEIGHTS).option("multiLine", True).json(path)
    return raw.select("method", F.posexplode("weights").alias("cls", "weight"))


def filter_parameters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILTER_PARAMETERS).option("multiLine", True).json(path).select("chosen.*")


def train_history(spark: SparkSession, path: str) -> DataFrame:
    """One row per run and epoch; the run is the file."""
    raw = spark.read.schema(HISTORY).option("multiLine", True).json(path)
    return raw.select(F.col("_metadata.file_path").alias("run"), "patience", F.explode("epochs").alias("e")).select(
        "run", "patience", "e.*")

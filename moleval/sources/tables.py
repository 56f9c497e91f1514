"""Readers (S1-S6, S11, S12).

All readers take an explicit schema (no inference pass over the data) and
turn NaN into NULL at the source so that every later comparison and
aggregate uses SQL three-valued logic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moleval.functions.scalars import nan_to_null, parse_list_literal
from moleval.sources.sinks import exists

MOLECULE_SCHEMA = T.StructType([
    T.StructField("_c0", T.LongType()),
    T.StructField("CID", T.LongType()),
    T.StructField("CanonicalSMILES", T.StringType()),
    T.StructField("XLogP", T.DoubleType()),
    T.StructField("ExactMass", T.DoubleType()),
    T.StructField("TPSA", T.DoubleType()),
    T.StructField("HBondDonorCount", T.LongType()),
    T.StructField("HBondAcceptorCount", T.LongType()),
])

RULE_NAMES = ["rule_index", "original", "group", "new_1", "new_2", "new_3"]

PROPERTY_SCHEMA = T.StructType([T.StructField("PropertyTable", T.StructType([
    T.StructField("Properties", T.ArrayType(T.StructType([
        T.StructField("CID", T.LongType()),
        T.StructField("CanonicalSMILES", T.StringType()),
        T.StructField("XLogP", T.DoubleType()),
        T.StructField("ExactMass", T.StringType()),
        T.StructField("TPSA", T.DoubleType()),
        T.StructField("HBondDonorCount", T.LongType()),
        T.StructField("HBondAcceptorCount", T.LongType()),
    ])))]))])

ID_SCAN_SCHEMA = T.StructType([T.StructField("PC_Compounds", T.ArrayType(T.StructType([
    T.StructField("id", T.StructType([T.StructField("id", T.StructType([
        T.StructField("cid", T.LongType())]))]))])))])

PROGRAM_SCHEMA = T.StructType([T.StructField("prog.predictor", T.StructType([
    T.StructField("demos", T.ArrayType(T.StructType([
        T.StructField("augmented", T.BooleanType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]))),
    T.StructField("signature", T.StructType([
        T.StructField("instructions", T.StringType()),
        T.StructField("fields", T.ArrayType(T.StructType([
            T.StructField("prefix", T.StringType()),
            T.StructField("description", T.StringType()),
        ]))),
    ])),
]))])


def _nan_free(df: DataFrame) -> DataFrame:
    return df.select(*[nan_to_null(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with header; an explicit schema avoids an inference pass."""
    r = spark.read.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return _nan_free(r.csv(path))


CORRUPT = "_corrupt_record"


def read_csv_checked(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """S1 with a report: (rows, remainder).  A line that does not fit ``schema`` (a cell of another type, too
    few or too many cells) is no row but stands in the remainder as (file, text).

    Lines are read as text, so a record is one line, and the header line of every file is left out.
    A reader that parses while it prunes columns would not look at all cells.
    """
    want = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    header = ",".join(want.fieldNames())
    full = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*want.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.where((F.trim("value") != "") & (F.col("value") != header)).select(
        "file", F.col("value").alias("text"), F.from_csv("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    bad = F.col(f"r.{CORRUPT}").isNotNull()
    rows = parsed.where(~bad).select(*[F.col(f"r.`{n}`").alias(n) for n in want.fieldNames()])
    return _nan_free(rows), parsed.where(bad).select("file", "text")


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    """S1 + S3: molecule table; the saved index column (``Unnamed: 0``/_c0) is dropped."""
    df = read_csv(spark, path, MOLECULE_SCHEMA)
    return df.drop("_c0")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule CSV read under one fixed set of names (the header is replaced);
    the first column becomes ``rule_index``."""
    schema = ", ".join(f"`{n}` {'int' if n == 'rule_index' else 'string'}" for n in RULE_NAMES)
    return spark.read.option("header", True).schema(schema).csv(path)


def read_predictions(spark: SparkSession, path: str, model: str) -> DataFrame:
    """S1 + P9: one model's prediction CSV -> the long layout
    ``(model, smiles, calculated, pred, group_descriptions, num_n, num_o)``.

    The wide ``{model}_pred`` column is renamed; the list-literal text
    column becomes ``ARRAY<STRING>``; absent columns become NULL.
    """
    raw = spark.read.option("header", True).csv(path)
    cols = set(raw.columns)

    def pick(name, typ):
        return F.col(f"`{name}`").try_cast(typ) if name in cols else F.lit(None).cast(typ)

    groups = (parse_list_literal(F.col("group_descriptions")) if "group_descriptions" in cols
              else F.lit(None).cast("array<string>"))
    out = raw.select(F.lit(model).alias("model"), F.col("smiles"),
                     pick("calculated", "double").alias("calculated"),
                     pick(f"{model}_pred", "double").alias("pred"),
                     groups.alias("group_descriptions"),
                     pick("num_n", "bigint").alias("num_n"), pick("num_o", "bigint").alias("num_o"))
    return _nan_free(out)


def read_prediction_set(spark: SparkSession, directory: str, models) -> DataFrame:
    """Every model's predictions as one long table (UNION of the files, whose
    headers differ by model).  Paths are checked on the file system that Spark
    reads, so shared storage works.  Missing files are skipped; see
    :func:`missing_models` for the report."""
    paths = {m: f"{directory.rstrip('/')}/{m}_predictions.csv" for m in models}
    parts = [read_predictions(spark, p, m) for m, p in paths.items() if exists(spark, p)]
    if not parts:
        raise FileNotFoundError(f"no prediction files for {list(models)} in {directory}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_programs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Saved program JSON -> one row per demonstration
    ``(program, demo_no, augmented, question, answer, instructions, fields)``;
    ``fields`` are the signature's (prefix, description) pairs.  ``multi_line=False``
    reads files with one program per line."""
    raw = spark.read.option("multiLine", multi_line).schema(PROGRAM_SCHEMA).json(path)
    p = F.col("`prog.predictor`")
    return raw.select(F.input_file_name().alias("program"),
                      p["signature"]["instructions"].alias("instructions"), p["signature"]["fields"].alias("fields"),
                      F.posexplode_outer(p["demos"]).alias("demo_no", "demo")).select(
        "program", "demo_no", F.col("demo.augmented").alias("augmented"),
        F.col("demo.question").alias("question"), F.col("demo.answer").alias("answer"), "instructions", "fields")


def parse_property_responses(responses: DataFrame, body: str = "body", status: str = "status") -> DataFrame:
    """Landed property responses (one JSON text per request) -> one row
    per property record; failed requests and absent keys give no rows."""
    ok = responses.where(F.col(status) == 200)
    parsed = ok.select(F.from_json(F.col(body), PROPERTY_SCHEMA).alias("_j"))
    return (parsed.select(F.explode_outer("_j.PropertyTable.Properties").alias("p"))
                  .where(F.col("p").isNotNull()).select("p.*"))


def parse_property_responses_checked(responses: DataFrame, ids: str = "cid_list", body: str = "body", status: str = "status") -> tuple[DataFrame, DataFrame]:
    """S5 with a report: (records, remainder).  The remainder has the bodies of successful requests that
    are no JSON, hold a value of another type, or have no property table, as (ids, reason, text)."""
    schema = T.StructType([*PROPERTY_SCHEMA.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = responses.where(F.col(status) == 200).select(F.col(ids).alias("ids"), F.col(body).alias("text"),
                                                          F.from_json(F.col(body), schema, {"columnNameOfCorruptRecord": CORRUPT}).alias("j"))
    table = F.col("j.PropertyTable.Properties")
    reason = F.when(F.col("text").isNull() | F.col(f"j.{CORRUPT}").isNotNull(), F.lit("unreadable")).when(table.isNull(), F.lit("no property table"))
    judged = parsed.withColumn("reason", reason)
    records = judged.where("reason IS NULL").select(F.explode(table).alias("p")).where(F.col("p").isNotNull()).select("p.*")
    return records, judged.where("reason IS NOT NULL").select(F.col("ids").alias(ids), "reason", "text")


def failed_requests(responses: DataFrame, ids: str = "cid_list", status: str = "status") -> DataFrame:
    """Requests whose status is not 200, with their id list."""
    return responses.where(~F.coalesce(F.col(status) == 200, F.lit(False))).select(ids, status)


def parse_id_scan(responses: DataFrame, body: str = "body") -> DataFrame:
    """Id-scan responses -> ``(chunk, has_compounds, cids ARRAY<BIGINT>)``."""
    j = F.from_json(F.col(body), ID_SCAN_SCHEMA)
    return responses.select("chunk", "status",
                            j["PC_Compounds"].isNotNull().alias("has_compounds"),
                            F.transform(j["PC_Compounds"], lambda c: c["id"]["id"]["cid"]).alias("cids"))


def require_columns(df: DataFrame, required) -> DataFrame:
    """Fail before any job runs when a required column is missing."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"missing required columns: {sorted(missing)}")
    return df


def missing_models(long: DataFrame, expected, model: str = "model") -> DataFrame:
    """Expected models with no rows in the long table."""
    spark = long.sparkSession
    exp = spark.createDataFrame([(m,) for m in expected], "model string")
    present = long.select(F.col(model).alias("model")).distinct()
    return exp.join(present, "model", "left_anti")

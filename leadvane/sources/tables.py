"""Readers and writers of every table, each with an explicit schema."""
from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadvane import schemas
from leadvane.config import AS_OF, TEST_FROM, RunDates
from leadvane.functions.text import text_or_null
from leadvane.operators.extras import Extra, FittedExtra, checked_number
from leadvane.operators.models import ValueModel, weights_frame
from leadvane.operators.quality import blank, require_unique
from leadvane.operators.value import FittedTransform, ValueTransform
from leadvane.sources.records import read_text_csv

# fixed values: cell spellings that mean "no value" in a raw source file
NULL_MARKERS = ("", "NA", "N/A", "n/a", "NULL", "null", "NaN", "nan", "None", "#N/A", "#NA", "<NA>", "-nan", "-NaN", "1.#IND",
                "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A")
FORMAT_VERSION = 1


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with a header: columns are matched by name, UTC timestamps parsed, absent columns null."""
    raw = read_text_csv(spark, path)
    header = raw.columns
    cells = []
    for f in schema:
        c = F.col(f"`{f.name}`") if f.name in header else F.lit(None).cast("string")
        if isinstance(f.dataType, T.TimestampType):
            c = F.to_timestamp(c)
        elif not isinstance(f.dataType, T.StringType):
            c = text_or_null(c).cast(f.dataType)
        cells.append(c.alias(f.name))
    return raw.select(*cells)


def read_leads(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.LEADS)


def read_crm(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.CRM)


def read_companies(spark: SparkSession, path: str) -> DataFrame:
    """Companies; a file without ``company_name`` is refused because name enrichment needs it."""
    if "company_name" not in spark.read.option("header", True).csv(path).columns:
        raise ValueError(f"{path} has no company_name column")
    return read_csv(spark, path, schemas.COMPANIES)


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """A foreign CSV, every cell text, the usual missing-value spellings as null."""
    raw = read_text_csv(spark, path)
    return raw.select([F.when(~F.col(f"`{c}`").isin(*NULL_MARKERS), F.col(f"`{c}`")).alias(c) for c in raw.columns])


def read_extras(spark: SparkSession, path: str, extras: Sequence[Extra]) -> DataFrame:
    """Extra features: only the empty cell is blank, exactly the declared columns, a filled unique key, finite numbers."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    want = ["lead_id", *[e.name for e in extras]]
    if raw.columns != want:
        raise ValueError(f"{path}: columns {raw.columns}, expected {want}")
    if raw.where(blank(F.col("lead_id"))).limit(1).count():
        raise ValueError(f"{path}: lead_id must be filled")
    require_unique(raw, "lead_id", path)
    return raw.select("lead_id", *[(checked_number(F.col(e.name), e.name) if e.kind == "numeric" else F.col(e.name)).alias(e.column)
                                   for e in extras])


def dataset_dates(spark: SparkSession, meta: DataFrame | None) -> tuple[RunDates, str | None]:
    """Run dates and currency from a one-row settings table, or the defaults without one."""
    if meta is None:
        return RunDates(AS_OF, TEST_FROM), "GBP"
    rows = meta.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("the dataset settings must be one row")
    row = rows[0].asDict()
    as_of, test_from, currency = row["as_of"], row["test_from"], row.get("currency")
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", str(test_from)):
        raise ValueError(f"test_from {test_from!r} is not a date")
    if str(test_from) > str(as_of)[:10]:
        raise ValueError(f"test_from {test_from} is after as_of {as_of}")
    if currency is not None and not re.fullmatch("[A-Z]{3}", currency):
        raise ValueError(f"currency {currency!r} must be three upper-case letters")
    return RunDates(str(as_of), str(test_from)), currency


def rules_schema() -> T.StructType:
    """The nested benchmark-rules document."""
    points = "array<struct<min_pages:double,points:double>>"
    return T._parse_datatype_string(
        "base_value_by_form map<string,double>, value_rules array<struct<name:string,field:string,`in`:array<string>,multiplier:double>>, "
        "lead_score struct<job_title:struct<keywords:array<struct<keyword:string,points:double>>,default_points:double,"
        f"missing_points:double>,company_size_points:map<string,double>,pages_visited_points:{points},"
        "tiers:array<struct<name:string,min_points:double,multiplier:double>>>")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(rules_schema()).option("multiLine", True).json(path)


def rules_from_row(rules: DataFrame) -> dict:
    """The single rules document as nested Python values for ``value.benchmark_value``."""
    return rules.first().asDict(recursive=True)


def write_table(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Parquet in the given column order."""
    (df.select(*columns) if columns else df).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV part files with a header and ISO UTC timestamps, blanks as empty cells."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss'Z'").csv(path)


# Output columns of a scoring run; horizon labels add three more.
SCORE_COLUMNS = ("lead_id", "created_at", "y", "p_formula", "deal_value_hat", "value_formula", "value_at_submit")
HORIZON_COLUMNS = ("won_within_h", "label_source", "matured_at")


def write_scores(scores: DataFrame, path: str, legacy: bool = False) -> None:
    write_table(scores, path, SCORE_COLUMNS if legacy else (*SCORE_COLUMNS, *HORIZON_COLUMNS))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_conversion(tables: Mapping[str, DataFrame], path: str, settings: Mapping[str, str | None]) -> None:
    """A converted dataset: leads, events, extras, counts, fill gaps, two empty dimensions and a settings row."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")
    write_table(spark.createDataFrame([], schemas.COMPANIES), f"{path}/companies")
    write_table(spark.createDataFrame([], schemas.PEOPLE), f"{path}/people")
    row = [(settings["as_of"], settings["test_from"], settings.get("currency"))]
    write_table(spark.createDataFrame(row, schemas.DATASET_DATES), f"{path}/settings")


def save_model(spark: SparkSession, path: str, win: Mapping[str, float], deal: ValueModel, transform: FittedTransform,
               extras: Sequence[FittedExtra] = ()) -> None:
    """Fitted parameters as small tables under one folder, with a format version."""
    write_table(weights_frame(spark, win), f"{path}/win_weights")
    write_table(weights_frame(spark, deal.weights), f"{path}/value_weights")
    settings = {"format": FORMAT_VERSION, "residual_sd": deal.residual_sd, "n_train": deal.n_train,
                "transform": {"cap_percentile": transform.spec.cap_percentile, "floor": transform.spec.floor,
                              "compression": transform.spec.compression, "tiers": transform.spec.tiers},
                "cap": transform.cap, "anchor": transform.anchor, "scale": transform.scale,
                "edges": list(transform.edges), "tier_values": list(transform.tier_values),
                "extras": [{"name": f.extra.name, "kind": f.extra.kind, "levels": list(f.levels), "reference": f.reference,
                            "edges": list(f.edges), "train_counts": f.train_counts} for f in extras]}
    write_table(spark.createDataFrame([(json.dumps(settings),)], "settings string"), f"{path}/settings")


def load_model(spark: SparkSession, path: str) -> tuple[dict[str, float], ValueModel, FittedTransform, tuple[FittedExtra, ...]]:
    """Reads ``save_model`` tables; refuses another format and tables that lack an intercept."""
    s = json.loads(spark.read.parquet(f"{path}/settings").first()["settings"])
    if s["format"] != FORMAT_VERSION:
        raise ValueError(f"{path}: format {s['format']}, expected {FORMAT_VERSION}")

    def weights(name: str) -> dict[str, float]:
        rows = spark.read.parquet(f"{path}/{name}").orderBy("position").collect()  # one row per design column
        w = {r["column"]: r["log_odds"] for r in rows}
        if "(intercept)" not in w:
            raise ValueError(f"{path}/{name} has no intercept")
        return w

    fitted = FittedTransform(ValueTransform(**s["transform"]), s["cap"], s["anchor"], s["scale"], tuple(s["edges"]), tuple(s["tier_values"]))
    extras = tuple(FittedExtra(Extra(e["name"], e["kind"]), tuple(e["levels"]), e["reference"], tuple(e["edges"]), e["train_counts"])
                   for e in s["extras"])
    return weights("win_weights"), ValueModel(weights("value_weights"), s["residual_sd"], s["n_train"]), fitted, extras

"""Sources and sinks: tables with stated schemas in, partitioned tables and reports out."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohorta.functions.exprs import kelvin_to_celsius, nan_to_null, require_columns


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in spark.checkpoint.dir, which driver and executors share; where that is unset and all run in one process, in a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="cohorta-")
    return f"{base.rstrip('/')}/cohorta-{tag}-{uuid.uuid4().hex}"


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to a scratch path and read back: cuts lineage and outlives lost executors."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",", columns: Sequence[str] | None = None) -> DataFrame:
    """A CSV table with a header; texts such as postal codes keep their zeros, as the schema is stated. Only ``columns`` are parsed."""
    df = nan_to_null(spark.read.schema(schema).option("header", True).option("sep", sep).csv(path))
    return df.select(*columns) if columns else df


def read_table(spark: SparkSession, path: str, needed: Sequence[str] = ()) -> DataFrame:
    df = nan_to_null(spark.read.parquet(path))
    require_columns(df, needed)
    return df


def rows_of(fact: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The fact rows of some ids: a semi-join, which Spark broadcasts where the ids are few and shuffles otherwise."""
    return fact.join(ids.select(key).distinct(), key, "left_semi")


def read_jdbc(spark: SparkSession, url: str, table: str, options: Mapping[str, str], partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """A database table; filters and columns of later steps are pushed into its query. ``partition`` is (column, low, high, parts)."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        r = r.options(partitionColumn=partition[0], lowerBound=partition[1], upperBound=partition[2], numPartitions=partition[3])
    return r.load()


def tidy_grid(df: DataFrame, variable: str = "t2m", time: str | None = None) -> DataFrame:
    """(time, lat, lon, value in degrees Celsius) of a reanalysis grid in Kelvin, under either name of its time."""
    t = time or next((c for c in ("valid_time", "time") if c in df.columns), None)
    require_columns(df, [variable, t or "valid_time", "latitude", "longitude"])
    return df.select(F.col(t).cast("timestamp").alias("time"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), kelvin_to_celsius(F.col(variable)).alias("value"))


def read_rings(spark: SparkSession, path: str) -> list[list[tuple[float, float]]]:
    """Rings of a polygon layer kept as JSON rows {"ring": [[x, y], ...]}; such layers are small and come to the driver."""
    return [[(p[0], p[1]) for p in r["ring"]] for r in spark.read.schema("ring array<array<double>>").json(path).collect()]


METRICS_SCHEMA = "map<string,map<string,struct<accuracy:double,precision:double,recall:double,f1_score:double,roc_auc:double,patient_classification_breakdown:map<string,array<bigint>>>>>"


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(subset, strategy, metrics...) of a metrics document; a document that does not parse gives no rows."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", METRICS_SCHEMA).alias("d"))
    by = doc.select(F.explode("d").alias("subset", "s")).select("subset", F.explode("s").alias("strategy", "m"))
    return by.select("subset", "strategy", "m.*")


def write_csv(df: DataFrame, path: str, sep: str = ";", rows: int = 0, append: bool = False) -> None:
    """A CSV table with a header, in files of up to ``rows`` rows (0: one for each task), replaced or appended to."""
    df.write.mode("append" if append else "overwrite").option("header", True).option("sep", sep).option("maxRecordsPerFile", rows).csv(path)


def write_monthly(df: DataFrame, path: str, day: str) -> None:
    """A table partitioned by year and month; only the months in ``df`` are replaced."""
    out = df.withColumns({"year": F.year(day), "month": F.month(day)}).repartition("year", "month")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)


def pending_months(df: DataFrame, path: str, day: str) -> DataFrame:
    """The rows of months that ``path`` does not hold yet."""
    months = df.withColumns({"year": F.year(day), "month": F.month(day)})
    try:
        done = df.sparkSession.read.parquet(path).select("year", "month").distinct()
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return months
        raise
    return months.join(done, ["year", "month"], "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_splits(parts: Mapping[str, DataFrame], key: str, path: str) -> None:
    """(split, key) of the ids of each part, so that a study can be repeated on the same rows."""
    frames = [df.select(F.lit(name).alias("split"), key).distinct() for name, df in parts.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    out.write.mode("overwrite").partitionBy("split").json(path)


def read_split(df: DataFrame, path: str, split: str, key: str) -> DataFrame:
    """The rows of ``df`` whose id is in a part that :func:`write_splits` has kept."""
    ids = df.sparkSession.read.schema(f"{key} {df.schema[key].dataType.simpleString()}, split string").json(path)
    return rows_of(df, ids.where(F.col("split") == split), key)


def finished(spark: SparkSession, path: str, key: str = "strategy") -> list[str]:
    """Names that a state folder of JSON rows holds; none where there is no folder yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return []
    return [r[0] for r in spark.read.schema(f"{key} string").json(path).select(key).distinct().collect()]


def metrics_document(metrics: DataFrame, subset: str = "global") -> str:
    """Metrics of a few strategies as one JSON text."""
    return json.dumps({subset: {r["strategy"]: {k: v for k, v in r.asDict(recursive=True).items() if k != "strategy"} for r in metrics.collect()}}, indent=2)


def markdown_report(title: str, sections: Mapping[str, DataFrame], rows: int = 50) -> str:
    """A report with a table for each (small) result; longer results are cut to ``rows`` and say so."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        got = df.limit(rows + 1).collect()
        cells = lambda r: " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r)
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *[f"| {cells(r)} |" for r in got[:rows]]]
        out += ["", f"(the first {rows} rows)"] if len(got) > rows else []
        out.append("")
    return "\n".join(out)

"""Writing and reading runs, exports and reports."""

from __future__ import annotations

import csv
import json
import logging
import platform
import shutil
from collections.abc import Iterable
from datetime import datetime
from graphlib import TopologicalSorter
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.sources import schemas

#: Tables that each step writes, in the order of the steps.
STEP_TABLES = {
    "select": ("selected_reviews",),
    "meta": ("meta_context",),
    "preprocess": ("normalized_reviews",),
    "sentences": ("review_sentences",),
    "opinion": ("opinion_candidates",),
    "extraction": ("aspect_sentiment_raw",),
    "judge": ("aspect_sentiment_valid", "extraction_issues"),
    "clustering": ("issue_clusters", "cluster_stats"),
    "insight": ("cluster_reports",),
    "evaluation": ("evaluation_metrics",),
    "report": (),
}
#: What each step needs.
STEP_NEEDS = {"select": (), "meta": ("select",), "preprocess": ("select",), "sentences": ("preprocess",), "opinion": ("sentences",), "extraction": ("opinion", "meta"), "judge": ("extraction",), "clustering": ("judge",), "insight": ("clustering",), "evaluation": ("judge", "clustering"), "report": ("insight", "evaluation")}
#: Tables that the lexicon path writes under a name of its own.
TRADITIONAL = ("aspect_sentiment_raw", "aspect_sentiment_valid", "extraction_issues", "issue_clusters", "cluster_stats", "cluster_reports")
#: Lines from which a prompt template begins (fixed values).
TEMPLATE_MARKS = ("## Prompt模板", "```")


def run_id(scope: str = "default", tag: str = "", now: datetime | None = None) -> str:
    """`yyyyMMdd-HHmm_scope[_tag]`."""
    return "_".join(x for x in ((now or datetime.now()).strftime("%Y%m%d-%H%M"), scope, tag) if x)


def order_of_steps(depends: dict[str, Iterable[str]]) -> list[str]:
    """Steps so that each follows what it depends on; a cycle is an error."""
    return list(TopologicalSorter({k: sorted(v) for k, v in depends.items()}).static_order())


def steps_from(order: list[str], first: str | None) -> list[str]:
    """The steps of a resumed run; an unknown step is an error, not a full run."""
    if first is None:
        return order
    if first not in order:
        raise ValueError(f"unknown step {first}")
    return order[order.index(first) :]


def latest_states(log: DataFrame) -> DataFrame:
    """(run_id, step_name, state, output_rows, error): the last event of every step; of events at one time the largest state."""
    last = F.max_by(F.struct("state", "output_rows", "error"), F.struct("logged_at", "state"))
    return log.groupBy("run_id", "step_name").agg(last.alias("s")).select("run_id", "step_name", "s.*")


def without_steps(log: DataFrame, run: str, steps: Iterable[str]) -> DataFrame:
    """The log without the events of some steps of a run; NULL runs and steps stay."""
    return log.where(~F.coalesce((F.col("run_id") == run) & F.col("step_name").isin(list(steps)), F.lit(False)))


class RunStore:
    """Tables of runs in one folder, partitioned by run, so that a run is read, replaced and dropped on its own."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def exists(self, table: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def write(self, df: DataFrame, table: str, run: str, **versions: str) -> None:
        """Replace this run's rows of a table, stamped with run, versions and time; other runs are untouched.

        Tables of the registry are brought into their declared columns; an empty frame leaves an empty run.
        """
        self._stamped(df, table, run, versions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(self.path(table))

    def append(self, df: DataFrame, table: str, run: str, **versions: str) -> None:
        """Add rows to a run of a table, stamped and in its declared columns."""
        self._stamped(df, table, run, versions).write.mode("append").partitionBy("run_id").parquet(self.path(table))

    def _stamped(self, df: DataFrame, table: str, run: str, versions: dict[str, str]) -> DataFrame:
        stamps = {"run_id": F.lit(run), "created_at": F.current_timestamp()} | {k: F.lit(v) for k, v in versions.items()}
        declared = table in schemas.TABLES and {"pipeline_version", "data_slice_id"} <= versions.keys()
        return schemas.conform(df.withColumns(stamps), table) if declared else df.withColumns(stamps)

    def read(self, table: str, run: str) -> DataFrame:
        """Rows of one run; only its partition is read. A declared table has its declared columns, and without any run is empty."""
        declared = table in schemas.TABLES
        if declared and not self.exists(table):
            return self.spark.createDataFrame([], schemas.schema_of(table))
        reader = self.spark.read.schema(schemas.schema_of(table)) if declared else self.spark.read.option("mergeSchema", "true")
        rows = reader.parquet(self.path(table))
        return rows.withColumn("run_id", F.col("run_id").cast("string")).where(F.col("run_id") == run)

    def drop(self, table: str, run: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(table)}/run_id={run}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def clean_from(self, step: str, run: str, tables: dict[str, tuple[str, ...]] = STEP_TABLES) -> list[str]:
        """Drop the run's rows of all tables that the step or a later one writes, and their log entries."""
        steps = steps_from(list(tables), step)
        gone = [t for s in steps for t in tables[s]]
        for t in gone:
            if self.exists(t):
                self.drop(t, run)
        if self.exists("run_log"):
            self.log(run, steps, "CLEANED")
        return gone

    def log(self, run: str, steps: Iterable[str], state: str, rows: int | None = None, error: str | None = None) -> None:
        """Append one event per step; earlier events are never changed."""
        data = [(run, s, state, rows, error) for s in steps]
        df = self.spark.createDataFrame(data, "run_id string, step_name string, state string, output_rows long, error string")
        df.withColumn("logged_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(self.path("run_log"))

    def state(self, run: str) -> DataFrame:
        """Latest state of every step of a run."""
        return latest_states(self.spark.read.parquet(self.path("run_log")).where(F.col("run_id") == run)).drop("run_id")

    def run_steps(self, run: str, steps: dict, depends: dict[str, Iterable[str]], first: str | None = None) -> list[str]:
        """Run step functions (store, run) -> rows written in order, logging each; a failure is logged and raised."""
        done = steps_from(order_of_steps(depends), first)
        for name in done:
            self.log(run, [name], "STARTED")
            try:
                rows = steps[name](self, run)
            except Exception as e:
                self.log(run, [name], "FAILED", error=str(e)[:2000])
                raise
            self.log(run, [name], "SUCCESS", rows)
        return done


def write_csv(df: DataFrame, path: str, order: list[str], columns: list[str] | None = None) -> int:
    """One CSV file with a byte-order mark, rows in order, streamed through the driver partition by partition."""
    n, columns = 0, columns or df.columns
    with open(path, "w", encoding="utf-8-sig", newline="") as file:
        out = csv.writer(file)
        out.writerow(columns)
        for row in df.orderBy(*order).select(*columns).toLocalIterator():
            out.writerow(["" if v is None else v for v in row])
            n += 1
    return n


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(original, normalized) of a CSV with a header, trimmed and in lower case; blank sides drop, of equal originals the last line counts.

    A taxonomy is a dictionary: it is read as one file, whose line order decides.
    """
    clean = {c: F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias(c) for c in ("original", "normalized")}
    rows = spark.read.option("header", True).schema("original string, normalized string").csv(path).coalesce(1).withColumn("line", F.monotonically_increasing_id())
    return rows.select("line", *clean.values()).where("original <> '' and normalized <> ''").groupBy("original").agg(F.max_by("normalized", "line").alias("normalized"))


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """Terms of the first column of a CSV with a header, trimmed and in lower case, in the order of the file."""
    with_header = spark.read.option("header", True).csv(path)
    first = with_header.columns[0]
    return [t for r in with_header.coalesce(1).select(first).collect() if (t := (r[0] or "").strip().lower())]  # a dictionary


def snapshot_config(folder: str, config: dict, run: str, pipeline_version: str, slice_name: str = "default", source: str | None = None) -> Path:
    """Save what a run was started with: a copy of its file, the configuration without private keys, and the environment."""
    target = Path(folder) / "config"
    target.mkdir(parents=True, exist_ok=True)
    if source and Path(source).exists():
        shutil.copy2(source, target / Path(source).name)
    info = {"run_id": run, "pipeline_version": pipeline_version, "data_slice_id": slice_name, "created_at": datetime.now().isoformat(), "config_file": source}
    write_json({"run_info": info, **_plain(_public(config))}, str(target / "run_config.json"))
    write_json({"python_version": platform.python_version(), "spark_version": pyspark.__version__}, str(target / "environment.json"))
    return target


def _plain(value: object) -> object:
    """A configuration as JSON can hold it: other objects as text."""
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, (str, int, float, bool)) else str(value)


def log_to_file(folder: str, name: str = "reviewloom", level: int = logging.INFO) -> logging.Logger:
    """Logger of a run that writes to the console and to a file in the run's folder; calling again adds no second handler."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    path, logger = str(Path(folder).resolve() / "run.log"), logging.getLogger(name)
    logger.setLevel(level)
    form = logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s")
    present = {getattr(h, "baseFilename", "console") for h in logger.handlers}
    for key, handler in (("console", logging.StreamHandler), (path, lambda: logging.FileHandler(path, encoding="utf-8"))):
        if key not in present:
            made = handler()
            made.setFormatter(form)
            logger.addHandler(made)
    return logger


def config_id(config: dict) -> str:
    """A configuration as JSON with its fields in the order of their names."""
    return json.dumps(_plain(config), sort_keys=True, ensure_ascii=False)


def safe_name(text: str, most: int = 50) -> str:
    """Text as part of a file name: letters, digits, `-` and `_`; anything else becomes `_`."""
    return "".join(c if c.isalnum() or c in "-_" else "_" for c in text)[:most]


def write_json(row: dict, path: str) -> None:
    Path(path).write_text(json.dumps(row, ensure_ascii=False, indent=2), encoding="utf-8")


def read_template(text: str) -> str:
    """Prompt of a template file: the lines behind the first mark without blank ones and headings, or the whole text."""
    started, lines = False, []
    for line in text.split("\n"):
        if any(m in line for m in TEMPLATE_MARKS):
            started = True
        elif started and line.strip() and not line.startswith("#"):
            lines.append(line)
    return "\n".join(lines).strip() if lines else text


def read_config(path: str) -> dict:
    """Run configuration from YAML, where its reader is installed, or JSON; keys that begin with `_` are left out."""
    text = Path(path).read_text(encoding="utf-8")
    try:
        import yaml
    except ImportError:
        data = json.loads(text)
    else:
        data = yaml.safe_load(text)
    return _public(data or {})


def _public(value: object) -> object:
    if isinstance(value, dict):
        return {k: _public(v) for k, v in value.items() if not str(k).startswith("_")}
    return [_public(v) for v in value] if isinstance(value, list) else value


def run_sql(spark: SparkSession, text: str, args: dict | None = None, writes: bool = False, **frames: DataFrame) -> DataFrame:
    """Ad-hoc statement with named parameters: a query gives its rows; anything else runs only if writes are allowed, and gives none."""
    if text.lstrip().upper().startswith(("SELECT", "WITH", "SHOW", "DESCRIBE", "EXPLAIN", "VALUES")):
        return spark.sql(text, args=args or {}, **frames)
    if not writes:
        raise ValueError("only queries are allowed here")
    spark.sql(text, args=args or {}, **frames)
    return spark.createDataFrame([], "result string")

"""Readers and writers of the engine's file formats."""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakline.functions import types as ty
from cloakline.operators import audit
from cloakline.operators.detect import Rule
from cloakline.operators.routing import ROUTE_SCHEMA

LABELLED = f"prompt string, spans {ty.SPANS.simpleString()}"
FINGERPRINT = "struct<output_hash:string,length_bucket:int,stop_reason:string,latency_bucket:int>"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, else in the warehouse. In local mode, where
    all is one machine, a temporary one will do."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not shared and spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        shared = "file://" + tempfile.mkdtemp(prefix="cloakline-")
    shared = shared or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/cloakline/{uuid.uuid4().hex}/{name}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """rows written and read again: what is read several times is computed once."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def write_labelled(rows: DataFrame, path: str) -> None:
    """Labelled prompts (prompt, spans) as JSON lines."""
    rows.select("prompt", F.transform("spans", lambda s: s.dropFields("confidence")).alias("spans")).write.json(path)


def write_evaluation(rows: DataFrame, path: str) -> None:
    """One JSON line per entry: idx, expected, detected, tp, fp, fn, latency."""
    rows.select("idx", "expected", "detected", "tp", "fp", "fn", "latency").write.json(path)


def labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled prompts from JSON lines. A line that can't be read fails the job; implicit defaults to false."""
    rows = spark.read.schema(LABELLED).option("mode", "FAILFAST").json(path)
    return rows.withColumn("spans", F.transform("spans", lambda s: s.withField("implicit", F.coalesce(s["implicit"], F.lit(False)))))


def locate_spans(text, wanted):
    """Spans from (text, type, occurrence, implicit): the offsets of the n-th occurrence, counted from 1."""

    def place(w):
        found = F.filter(F.sequence(F.lit(0), F.greatest(F.length(text) - F.length(w["text"]), F.lit(0))), lambda i: F.substring(text, i + 1, F.length(w["text"])) == w["text"])
        start = F.get(found, w["occurrence"] - 1)
        return ty.span(w["type"], start, start + F.length(w["text"]), w["text"], F.lit(1.0), w["implicit"])

    return F.filter(F.transform(wanted, place), lambda s: s["start"].isNotNull())


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a file or of a folder's *.jsonl and *.json files, with file and place as order, missing fields as defaults.

    Lines carry their order in the chain of hashes; the place column follows it within a file.
    """
    rows = spark.read.schema(audit.DDL).option("pathGlobFilter", "*.{jsonl,json}").option("mode", "FAILFAST").json(path)
    rows = rows.select("*", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start").cast("decimal(20,0)") * F.lit(1 << 33) + F.monotonically_increasing_id() % (1 << 33)).alias("place"))
    return audit.with_defaults(rows)


def write_audit(entries: DataFrame, path: str, day: str = "day") -> None:
    """Append entries as JSON lines, a folder for each day, each day's lines in one ordered range."""
    fields = [n for n, *_ in audit.FIELDS]
    entries.select(day, *fields).repartitionByRange(F.col(day), F.col("timestamp")).sortWithinPartitions(day, "timestamp").write.mode("append").partitionBy(day).json(path)


def write_checkpoints(heads: DataFrame, path: str, batch: str = "batch", order: str = "pos") -> None:
    """Append one row per batch of heads: its root, how many, the first and the last. Fits foreachBatch."""
    audit.merkle_roots(heads, batch, order).write.mode("append").parquet(path)


def append_stream(entries: DataFrame, path: str, checkpoint: str):
    """A streaming query that appends audit entries, a bounded micro-batch at a time: the source's maxFilesPerTrigger or
    maxOffsetsPerTrigger is the bound, and what doesn't fit waits at the source instead of being refused."""
    return entries.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, _: write_audit(rows, path)).start()


def write_mappings(rows: DataFrame, path: str) -> None:
    """Append mapping rows, a folder for each day so that expiry drops whole folders."""
    rows.withColumn("day", F.to_date("created_at")).write.mode("append").partitionBy("day").parquet(path)


def expired_days(spark: SparkSession, path: str, today: str, keep_days: int) -> DataFrame:
    """The day folders past retention."""
    days = spark.read.parquet(path).select("day").distinct()
    return days.filter(F.col("day") < F.date_sub(F.lit(today).cast("date"), keep_days))


def _mapping(text: str) -> dict:
    """YAML if its library is there, else JSON, which is a part of YAML."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def rules_from_text(text: str) -> list[Rule]:
    """User rules. Unknown types are persons; patterns that don't compile and empty keywords are left out."""
    import re

    out = []
    short = {"ORG": "ORGANIZATION"}
    for r in (_mapping(text) or {}).get("rules", []):
        type_ = str(r["type"]).upper()
        type_ = short.get(type_, type_)
        patterns = []
        for p in r.get("patterns") or []:
            try:
                re.compile(p)
            except re.error:
                continue
            patterns.append(p)
        out.append(Rule(r["name"], type_ if type_ in ty.TYPE_NAMES else "PERSON", patterns, [k for k in r.get("keywords") or [] if k], float(r.get("confidence", 0.8))))
    return out


def routes_from_text(spark: SparkSession, text: str | None) -> DataFrame:
    """Routes in order; no routes for a missing or unreadable file."""
    try:
        found = (_mapping(text) or {}).get("routes", []) if text else []
        rows = [(i, r["name"], int(r["score_min"]), int(r["score_max"]), r["upstream_url"], str(r["api_format"]).lower(), r["api_key_env"]) for i, r in enumerate(found)]
    except Exception:  # noqa: BLE001  any defect of the file means default routing
        rows = []
    return spark.createDataFrame(rows, ROUTE_SCHEMA)


def endpoints_from_text(spark: SparkSession, text: str) -> DataFrame:
    """host and port of an endpoints file; raises if an entry has no host or a port out of range."""
    rows = []
    for e in (_mapping(text) or {}).get("endpoints", []):
        host, port = str(e.get("host") or ""), int(e.get("port", 443))
        if not host or not 0 < port < 65_536:
            raise ValueError(f"bad endpoint {e}")
        rows.append((host, port))
    return spark.createDataFrame(rows, "host string, port int")


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """model_label, prompt and fingerprint of a baseline file; fails if it can't be read."""
    schema = f"model_label string, created_at string, engine_version string, prompts map<string,{FINGERPRINT}>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select("model_label", F.explode("prompts").alias("prompt", "f")).select("model_label", "prompt", "f.*")


def write_baseline(fingerprints: DataFrame, path: str) -> None:
    """One JSON object with prompts in order. fingerprints: model_label, created_at, engine_version, prompt and features."""
    f = F.struct("output_hash", "length_bucket", "stop_reason", "latency_bucket")
    rows = fingerprints.groupBy("model_label", "created_at", "engine_version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("prompt").alias("key"), f.alias("value"))))).alias("prompts"))
    rows.write.mode("overwrite").json(path)


def duration_seconds(text):
    """N, Nh or Nd as seconds; null if it is none of them."""
    number = F.regexp_extract(text, r"^(\d+)[hd]?$", 1).try_cast("long")
    return F.when(F.rlike(text, F.lit(r"^\d+h$")), number * 3600).when(F.rlike(text, F.lit(r"^\d+d$")), number * 86400).when(F.rlike(text, F.lit(r"^\d+$")), number)


@dataclass
class Options:
    """Engine options, with the environment's names in upper case."""

    scan_mode: str = "auto"
    session_ttl_seconds: int = 86_400
    audit_retention_days: int = 30
    show_score: bool = True
    stream: bool = True

    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "CLOAKLINE_") -> Options:
        out = {}
        for name, default in asdict(cls()).items():
            value = env.get(prefix + name.upper())
            if value is None:
                continue
            if isinstance(default, bool):
                out[name] = value.lower() in ("1", "true", "yes")
            elif isinstance(default, int):
                unit = {"h": 3600, "d": 86_400}.get(value[-1:], 1)
                number = int(value[:-1] if unit > 1 else value)
                out[name] = number if name.endswith("days") and value[-1:] == "d" else number * unit
            else:
                out[name] = value
        if out.get("scan_mode", "auto").lower() not in ("fast", "deep", "auto"):
            raise ValueError(f"unknown scan mode {out['scan_mode']}")
        return cls(**out)

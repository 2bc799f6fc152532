"""One scan from a folder or table of files to a report: discover, detect, look again, analyse, write."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from functools import reduce

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sundew import __version__
from sundew.functions import patterns, proximity
from sundew.operators import context, detect, discovery
from sundew.session import durable
from sundew.sinks import reports
from sundew.sources import config, repositories


def findings_of(files: DataFrame, path: str = "path", text: str = "text", rules: bool = True, near: bool = False, settings: dict | None = None) -> DataFrame:
    """Findings of both detectors over files: file, line, col, kind, value, context, validated, confidence, risk_level,
    is_test, detector_name.

    ``settings`` are those of ``sources.config``: which detectors run, whether they check context and checksums, the least
    confidence, the rules.  With ``near`` (or its setting) the pattern findings' confidence and risk also pass through
    proximity analysis of their window.  ``rules`` and ``near`` add to what the settings say.
    """
    s = config.merged(config.DEFAULTS, settings or {})
    on, least = s["detectors"], s["scanner"]["min_confidence"]
    keyed = files.withColumn("_id", F.xxhash64(path))
    columns = ["file", "line", "col", "kind", "value", "context", "validated", "confidence", "risk_level", "is_test", "detector_name"]
    parts = []
    if on["pattern"]:
        found = detect.detect(
            keyed, "_id", path, text, whole_path=True, gates=on["context_validation"], max_bytes=s["scanner"]["max_file_size"], checked=on["checksums"], min_confidence=least
        )
        if on["context_validation"]:
            found = context.validated(found)
        line = F.get("lines", F.col("at") - 1)
        found = found.withColumns({"context": line, "is_test": F.col("context_modifier") <= 0.1})
        if near or on["proximity"]:
            window = F.array_join("lines", "\n")
            found = found.withColumn("_e", proximity.enhanced(window, F.col("value"), F.col("confidence"), F.col("risk_level")))
            found = found.withColumns({"confidence": F.col("_e.confidence"), "risk_level": F.col("_e.risk_level")})
        parts.append(found.select(*columns))
    if rules and on["rules"]:
        table, allowed = config.rule_file(on["rule_file"]) if on["rule_file"] else (patterns.RULE_SETS[on["rule_set"]], patterns.SECRET_ALLOWED)
        secret = detect.detect_rules(keyed.where(F.octet_length(text) <= s["scanner"]["max_file_size"]), "_id", path, text, table, allowed)
        secret = secret.where(F.col("confidence") >= least)
        parts.append(secret.withColumns({"validated": F.lit(False), "is_test": F.col("context_modifier") <= 0.1}).select(*columns))
    if not parts:
        raise ValueError("no detector is switched on")
    return reduce(DataFrame.unionByName, parts)


def scan(
    spark: SparkSession, root: str, out: str, name: str = "", formats: tuple[str, ...] = ("json",), started: datetime | None = None, settings: dict | None = None, **rules: object
) -> dict:
    """Scan a folder and write its reports under ``out``; returns the head of the result.

    ``settings`` as in ``findings_of``, with those of discovery and reports; ``rules`` are further arguments of discovery.
    A folder that can't be read, bad settings or a failed job give a result with that error; other errors are raised.
    """
    began = started or datetime.now(UTC).replace(tzinfo=None)
    s = config.merged(config.DEFAULTS, settings or {})
    d = s["discovery"]
    rules = {"max_size": s["scanner"]["max_file_size"], "include_hidden": d["include_hidden"], "exclude_binary": d["exclude_binary"]} | rules
    rules |= {k: tuple(d[k]) for k in ("include", "exclude") if d[k]}
    try:
        tree = repositories.read_tree(spark, root)
        files = repositories.discover(spark, root, **rules)
        found = durable(findings_of(files, settings=s))
        sizes = tree.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("b")).first()
        scanned = files.count()
        counts = {"total_files": sizes.n, "scanned_files": scanned, "skipped_files": sizes.n - scanned, "total_size": sizes.b}
        ended = datetime.now(UTC).replace(tzinfo=None) if started is None else began
        head = reports.scan_result(found, {"url": name or root, "local_path": root}, began, ended, counts)
        if "json" in formats:
            reports.write_json(found, head, f"{out}/json")
        write_reports(found, head, out, formats, s)
    except (PySparkException, Py4JError, OSError, ValueError) as e:  # the result file says what went wrong
        head = {"repository": {"url": name or root}, "scan_started": began.isoformat(), "error": str(e)}
        reports.write_head(head, f"{out}/json", spark)
    return head


def write_reports(found: DataFrame, head: dict, out: str, formats: tuple[str, ...], settings: dict | None = None) -> None:
    """The reports of a scan's findings in all formats but its own JSON."""
    s = config.merged(config.DEFAULTS, settings or {})["report"]
    name, began = head["repository"]["url"], datetime.fromisoformat(head["scan_started"])
    seconds = head.get("duration", 0) / 1e9
    if "csv" in formats:
        told = {"seconds": seconds, "version": __version__} if s["metadata"] else None
        reports.write_csv(reports.csv_rows(found, name, "", began, masked=s["masked"], context=s["context"], metadata=told), f"{out}/csv")
        reports.write_csv(reports.summary_rows(found, name, "", began, seconds), f"{out}/summary")
    if "sarif" in formats:
        reports.sarif_report(found.withColumn("repository", F.lit(name)), "sundew", __version__, ["repository"]).write.mode("overwrite").json(f"{out}/sarif")
    if "html" in formats:
        reports.write_text(found.sparkSession, f"{out}/report.html", reports.html_page(found, f"Scan of {name}"))


def report(spark: SparkSession, result: str, out: str, formats: tuple[str, ...] = ("html",), settings: dict | None = None) -> dict:
    """Reports from a scan's saved result (the folder that holds ``scan.json`` and ``findings``); returns its head."""
    head = json.loads(reports.read_text(spark, f"{result}/scan.json"))
    if "error" in head:
        raise ValueError(f"the scan failed: {head['error']}")
    write_reports(spark.read.schema(reports.SAVED).json(f"{result}/findings"), head, out, formats, settings)
    return head


def stats(spark: SparkSession, root: str) -> DataFrame:
    """Statistics of the files that discovery sees."""
    return discovery.discovery_stats(repositories.read_tree(spark, root))

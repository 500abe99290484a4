"""The three entry points: file -> Parquet, file -> profile, database -> Parquet.

A conversion claims a version number, which no other writer can get, appends ``pending`` to the ledger, writes
and checks the version's folder, and then appends ``active`` with the metrics: that last append is the commit. Any
failure appends ``error``. Rows of delimited text that were cut or left out lie next to the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType

from sluice.functions.types import spark_type
from sluice.operators import ledger
from sluice.operators.positions import split_rows
from sluice.operators.profile import SAMPLE_ROWS, head, held_sample, profile, totals
from sluice.operators.profile_state import incremental_profile
from sluice.operators.quality import warnings
from sluice.operators.shape import shape
from sluice.plans.claims import claim
from sluice.plans.sink import CODECS, ROW_GROUP_ROWS, Written, output_path, profile_path, quarantine_path, source_path, version_path, write_checked
from sluice.sources.databases import connection_options, extract_query, extract_table
from sluice.sources.excel import PLACE
from sluice.sources.files import PLACE as CSV_PLACE
from sluice.sources.files import FORMAT_OPTIONS, FORMATS, Checked, scan_csv_checked, scan_file
from sluice.sources.sniff import read_text_as, sniff_types

READ_OPTIONS = (
    "delimiter", "encoding", "header", "multi_line", "types", "sniff", "sniff_rows", "ignore_errors", "schema",
    "sheet_name", "sheet_index",
)
QUARANTINE = "row string, reason string, dropped boolean"
SHAPE_OPTIONS = ("column_mapping", "type_overrides", "skip_rows", "order_by")


@dataclass(frozen=True)
class Workspace:
    """Where sources, versions and outputs live: a root folder and the table of sources."""

    spark: SparkSession
    root: str
    sources: DataFrame

    @property
    def ledger_path(self) -> str:
        return f"{self.root.rstrip('/')}/ledger"

    def events(self, source_id: str | None = None) -> DataFrame:
        try:
            return ledger.read_events(self.spark, self.ledger_path, source_id)
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], ledger.EVENTS)

    def current_version(self, source_id: str) -> int:
        found = ledger.current_versions(self.events(source_id)).first()
        return found.current_version if found else 0

    def read(self, source_id: str, version: int | None = None) -> DataFrame:
        """The data of a version, by default the current one."""
        return self.spark.read.parquet(output_path(self.root, *self._place(source_id, version)))

    def profile(self, source_id: str, version: int | None = None, approximate: bool = False) -> DataFrame:
        """The profile of a version, by default the current one; it is kept next to the data, which is read once for it."""
        place = self.root, *self._place(source_id, version)
        return incremental_profile(self.spark, output_path(*place), profile_path(*place), approximate)

    def quarantine(self, source_id: str, version: int | None = None) -> DataFrame:
        """``(row, reason, dropped)`` of the rows that a version's conversion cut or left out; empty if there were none."""
        try:
            return self.spark.read.schema(QUARANTINE).parquet(quarantine_path(self.root, *self._place(source_id, version)))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], QUARANTINE)

    def _place(self, source_id: str, version: int | None) -> tuple[str, str, int]:
        source = ledger.get_source(self.sources, source_id)
        return source["organization_id"], source_id, version if version is not None else self.current_version(source_id)


def convert_file(work: Workspace, source_id: str, file_format: str | None = None, options: dict | None = None, compression: str = "zstd") -> dict:
    """Convert the uploaded files of a source into its next version; returns the metadata."""
    source = ledger.get_source(work.sources, source_id)
    options = {k: v for k, v in (options or {}).items() if v is not None}
    unknown = set(options) - set(READ_OPTIONS) - set(SHAPE_OPTIONS)
    if unknown:
        raise ValueError(f"no options named {sorted(unknown)}")
    chosen = file_format or source["connector_type"]

    def plan() -> Plan:
        if chosen not in FORMATS:
            raise ValueError(f"no file format named {chosen!r}")
        path = source_path(work.root, source["organization_id"], source_id)
        checked = checked_scan(work.spark, path, chosen, options)
        df, removed = plan_file(work.spark, path, chosen, options, checked)
        return Plan(df, {"source_type": "file"}, removed, checked)

    return _run(work, source, plan, compression, ROW_GROUP_ROWS, None)


def checked_scan(spark: SparkSession, path: str, file_format: str, options: dict | None = None) -> Checked | None:
    """The scan of delimited text that keeps account of bad rows; other formats have none."""
    if file_format not in ("csv", "tsv"):
        return None
    known = {k: v for k, v in (options or {}).items() if k in FORMAT_OPTIONS["csv"]}
    if file_format == "tsv":
        known["delimiter"] = known.get("delimiter") or "\t"
    placed = bool((options or {}).get("skip_rows")) and not (options or {}).get("order_by")
    return scan_csv_checked(spark, path, placed=placed, **known)


def plan_file(
    spark: SparkSession, path: str, file_format: str, options: dict | None = None, checked: Checked | None = None
) -> tuple[DataFrame, DataFrame | None]:
    """Scan, shape and skip rows as one lazy plan; with skipped rows also the frame of those removed."""
    options = options or {}
    overrides = options.get("type_overrides") or {}
    for name in overrides.values():
        spark_type(name)
    skipped, order_by = options.get("skip_rows"), options.get("order_by")
    # Workbook rows lose their file on the way through Python, so they carry their place.
    place = list(PLACE) if skipped and file_format == "excel" and not order_by else []
    checked = checked or checked_scan(spark, path, file_format, options)
    if checked and not order_by:
        place = [c for c in CSV_PLACE if c in checked.data.columns]
    raw = checked.data if checked else scan_file(spark, path, file_format, place=bool(place), **{k: options.get(k) for k in READ_OPTIONS})
    shaped = shape(raw, options.get("column_mapping"), overrides)
    if not skipped:
        return shaped, None
    kept, removed = split_rows(shaped, skipped, order_by or place or None)
    return kept.drop(*place), removed


def infer_file(
    work: Workspace, source_id: str, file_format: str | None = None, sample_size: int | None = SAMPLE_ROWS, order_by: list[str] | None = None
) -> dict[str, DataFrame]:
    """Profile a source's files before conversion: totals, columns, head rows and warnings as DataFrames.

    ``sample_size=None`` profiles all rows. No row is dropped here, and the delimiter is detected. A sample of delimited
    text has the types that its own rows tell; only the columns that order it are typed on all rows.
    """
    source = ledger.get_source(work.sources, source_id)
    chosen = file_format or source["connector_type"]
    path = source_path(work.root, source["organization_id"], source_id)
    options = {"delimiter": None} if chosen == "csv" else {}
    checked = checked_scan(work.spark, path, chosen, {"ignore_errors": False, "sniff": sample_size is None, **options})
    if checked and sample_size is not None:
        return _findings(_typed_sample(checked.data, sample_size, order_by), order_by, True)
    df = checked.data if checked else scan_file(work.spark, path, chosen)
    return infer(df, sample_size, order_by)


def _typed_sample(text: DataFrame, sample_size: int, order_by: list[str] | None) -> DataFrame:
    """A sample of text columns, typed by its own rows; the order is that of values, so its columns are typed first, on all rows."""
    leading = [c for c in order_by or [] if isinstance(text.schema[c].dataType, StringType)]
    rows = held_sample(read_text_as(text, sniff_types(text, leading), sniffed=True), sample_size, order_by)
    rest = [f.name for f in rows.schema.fields if isinstance(f.dataType, StringType) and f.name not in leading]
    return read_text_as(rows, sniff_types(rows, rest), sniffed=True)


def infer(df: DataFrame, sample_size: int | None = SAMPLE_ROWS, order_by: list[str] | None = None) -> dict[str, DataFrame]:
    """Totals, columns, head rows and warnings of a table or its sample."""
    rows = df if sample_size is None else held_sample(df, sample_size, order_by)
    return _findings(rows, order_by, sample_size is not None)


def _findings(rows: DataFrame, order_by: list[str] | None, formats_of_samples: bool) -> dict[str, DataFrame]:
    columns = profile(rows, order_by=order_by, formats_of_samples=formats_of_samples)
    return {"totals": totals(rows), "columns": columns, "head": head(rows, order_by), "warnings": warnings(rows, order_by)}


def convert_database(
    work: Workspace,
    source_id: str,
    credentials: dict,
    query: str | None = None,
    table_name: str | None = None,
    compression: str = "zstd",
    row_group_size: int = ROW_GROUP_ROWS,
    pushdown: bool | None = None,
    partition_column: str | list[str] | None = None,
    partition_num: int | None = None,
) -> dict:
    """Extract a table or a query's result into the source's next version; ``query`` beats ``table_name``."""
    source = ledger.get_source(work.sources, source_id)
    kind = source["connector_type"]
    asked = query if query is not None else (f"SELECT * FROM {table_name}" if table_name else None)

    def plan() -> Plan:
        if asked is None:
            raise ValueError("a query or a table is needed")
        connection_options(kind, credentials)
        split = {"partition_column": partition_column, "partition_num": partition_num}
        if query is not None:
            df = extract_query(work.spark, kind, credentials, query, pushdown, **split)
        else:
            df = extract_table(work.spark, kind, credentials, table_name, **split)
        info = {"connector_type": kind, "query": asked, "compression": compression, "engine": "spark"}
        return Plan(df, {"source_type": "database", "connection_info": info})

    return _run(work, source, plan, compression, row_group_size, asked)


@dataclass(frozen=True)
class Plan:
    """What a conversion writes: the data, what its result says, the rows skipped and the scan that tells of bad rows."""

    data: DataFrame
    info: dict
    removed: DataFrame | None = None
    checked: Checked | None = None


def _run(work: Workspace, source: dict, plan: Callable[[], Plan], compression: str, row_group_size: int, query: str | None) -> dict:
    """claim a number -> pending -> write and check -> active, or error."""
    source_id, record = source["id"], uuid.uuid4().hex
    place = work.root, source["organization_id"], source_id
    events = work.events(source_id)
    current = ledger.current_versions(events).first()
    first = (current.current_version if current else 0) + 1
    # Attempts at the numbers that are still open; those that failed have given theirs back.
    closed = ledger.version_records(events.where(F.col("version") >= first), ()).where("status = 'error'").select("id", "version").collect()
    version = claim(work.spark, lambda n: version_path(*place, n), first, record, {r.id for r in closed})
    # Files under a number that only failed attempts had give way.
    leftover = any(r.version == version for r in closed)

    def note(status: str, **fields) -> None:
        event = {**dict.fromkeys(ledger.EVENTS.fieldNames()), "event_ts": datetime.now(timezone.utc), "id": record}
        event.update(source_id=source_id, version=version, status=status, **fields)
        ledger.append_events(work.spark.createDataFrame([tuple(event.values())], ledger.EVENTS), work.ledger_path, source_id)

    note("pending")
    try:
        if compression not in CODECS:
            raise ValueError(f"no compression named {compression!r}")
        made = plan()
        path, mode = output_path(*place, version), "overwrite" if leftover else "errorifexists"
        done: Written = write_checked(made.data, path, compression, row_group_size, mode)
        skipped = made.removed.count() if made.removed is not None else 0
        told = _quarantined(made.checked, quarantine_path(*place, version), mode) if made.checked else []
    except Exception as error:
        note("error", error_message=str(error))
        raise
    note(
        "active",
        row_count=done.rows,
        column_count=done.columns,
        file_size_bytes=done.size_bytes or None,
        processing_time_seconds=done.seconds,
        extraction_query=query,
    )
    return {
        "version": version,
        "path": path,
        "rows": done.rows,
        "columns": done.columns,
        "column_schema": {"fields": [{"name": n, "type": t} for n, t in done.fields]},
        "file_size_mb": round(done.size_bytes / 1024 / 1024, 2),
        "processing_time_seconds": done.seconds,
        "rows_skipped": skipped or None,
        "warnings": told,
        **made.info,
    }


def _quarantined(checked: Checked, path: str, mode: str) -> list[str]:
    """Writes the rows that were cut or left out, counted on the way, and says how many there are."""
    if checked.sound:
        return []
    seen = Observation()
    counts = F.sum((~F.col("dropped")).cast("long")).alias("cut"), F.sum(F.col("dropped").cast("long")).alias("dropped")
    checked.quarantine().observe(seen, *counts).write.mode(mode).option("compression", "zstd").parquet(path)
    said = [(seen.get["cut"] or 0, "cut to the width of the header"), (seen.get["dropped"] or 0, "left out, as cells do not fit their types")]
    return [f"{n} rows {what}" for n, what in said if n]

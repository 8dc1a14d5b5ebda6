"""Facts from log lines, measurement records, folder names and file names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text

# ---- fixed values: the lines' and folders' formats ----
CHECKED = r"(?m)^ADAPTER_CHECK model=(\S+) differs=([01]) tool_calls_ok=([01])"
MERGED = r"(?m)^MERGE_OK model=(\S+) modules_applied=(\d+) tensors_changed=(\d+)"
THROTTLED = r"(?i)\b429\b|rate limit|too many requests|quota"
SAMPLE_DIR = r"(?:^|/)s(\d+)(?:/|$)"
PACKAGE_DIR = r"^([A-Za-z0-9_.]+)-(\d[^-/]*)\.dist-info$"
# -------------------------------------------------------


def serve_checks(log: Column) -> Column:
    """map<model, struct<differs, calls_ok>>: the last check line of each model."""
    return _last_by_model(log, CHECKED, lambda a, b: F.struct((a == "1").alias("differs"), (b == "1").alias("calls_ok")))


def serve_merges(log: Column) -> Column:
    """map<model, struct<modules, tensors>>: the last merge line of each model."""
    return _last_by_model(log, MERGED, lambda a, b: F.struct(a.cast("long").alias("modules"), b.cast("long").alias("tensors")))


def _last_by_model(log: Column, pattern: str, value) -> Column:
    part = lambda i: F.regexp_extract_all(text(log), F.lit(pattern), F.lit(i))
    rows = F.arrays_zip(part(1).alias("m"), part(2).alias("a"), part(3).alias("b"))
    # sorted by model and place, a model's last line stands before another model's first
    ordered = F.array_sort(F.transform(rows, lambda r, i: F.struct(r["m"].alias("m"), i.alias("i"), r["a"].alias("a"), r["b"].alias("b"))))
    last = lambda all_: F.filter(all_, lambda r, i: F.coalesce(F.get(all_, i + 1)["m"] != r["m"], F.lit(True)))
    kept = F.flatten(F.transform(F.array(ordered), last))  # held in a lambda's variable, the sort is done once
    return F.map_from_entries(F.transform(kept, lambda r: F.struct(r["m"], value(r["a"], r["b"]))))


def measurements(record: Column) -> Column:
    """struct of a measurement record (JSON text); what it lacks is null."""
    at = lambda path: F.get_json_object(record, f"$.{path}")
    return F.struct(
        at("best.tokens_per_s").cast("double").alias("tokens_per_s"), at("best.per_device_batch_size").cast("int").alias("batch_size"), at("best.grad_accum").cast("int").alias("grad_accum"),
        at("checks_ok").cast("boolean").alias("checks_ok"), at("resume.ok").cast("boolean").alias("resume_ok"),
    )


def created_at(stamp: Column) -> Column:
    """Seconds since 1970 of a UTC time such as 2024-01-31T10:00:00Z; null for other texts."""
    return F.try_to_timestamp(F.when(text(stamp).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$"), stamp), F.lit("yyyy-MM-dd'T'HH:mm:ssX")).cast("double")


def throttled(message: Column) -> Column:
    return text(message).rlike(THROTTLED)


def sample_of(path: Column) -> Column:
    """Number of the sample whose folder a path goes through; 0 without one."""
    return F.coalesce(F.regexp_extract(text(path), SAMPLE_DIR, 1).try_cast("int"), F.lit(0))


def run_path(root: str, tag: Column, split: Column) -> Column:
    """Folder of a run's split; a tag that is no single path segment fails the query."""
    fine = tag.isNull() | (tag.rlike(r"^[A-Za-z0-9._-]+$") & ~tag.isin(".", ".."))
    return F.when(fine, F.concat_ws("/", F.lit(root.rstrip("/")), tag, split)).otherwise(F.raise_error(F.concat(F.lit("no path segment: "), tag)).cast("string"))


def rung_name(folder: Column, names: dict[str, str]) -> Column:
    """The name of a rung's folder; others keep theirs."""
    return F.coalesce(*(F.when(folder == k, F.lit(v)) for k, v in names.items()), folder)


def package_version(folder: Column) -> Column:
    """struct<package, version> of an installed package's folder, null for other folders."""
    name = F.regexp_extract(text(folder), PACKAGE_DIR, 1)
    return F.when(name != "", F.struct(F.replace(F.lower(name), F.lit("_"), F.lit("-")).alias("package"), F.regexp_extract(text(folder), PACKAGE_DIR, 2).alias("version")))


def percent(n: Column, total: Column) -> Column:
    """A share in words: 12.5%, or n/a of nothing."""
    return F.when(total > 0, F.concat(F.format_number(100 * n / total, 1), F.lit("%"))).otherwise("n/a")

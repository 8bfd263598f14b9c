"""Reading many tables of comments and keeping track of the files they come from."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import MissingColumnError
from ..functions.files import file_name, file_suffix
from ..session import materialise
from .spanning import files_with_returns, n_fields, read_spanning

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet", ".orc": "orc"}
MAX_FILE_BYTES = 50 * 1024 * 1024

# Dialect of the CSV files: RFC 4180, as pandas reads and writes them.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "mode": "PERMISSIVE",
}

UTF8 = "utf-8"
LATIN1 = "latin-1"
_SPARK_CHARSETS = {UTF8: "UTF-8", LATIN1: "ISO-8859-1"}


def present_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """The paths that exist. Listing only; missing ones are found by halving the list."""
    paths = list(paths)
    if not paths:
        return []
    try:
        spark.read.format("binaryFile").load(paths)
        return paths
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    middle = len(paths) // 2
    return present_paths(spark, paths[:middle]) + present_paths(spark, paths[middle:]) if middle else []


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(file_path, source_file, suffix, size_bytes, size_mb)`` without reading contents."""
    found = present_paths(spark, paths)
    if not found:
        listed = spark.createDataFrame([], "path STRING, length BIGINT")
    else:
        listed = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(found)
            .select("path", "length")
        )
    path = F.col("path")
    return listed.select(
        path.alias("file_path"),
        file_name(path).alias("source_file"),
        file_suffix(path).alias("suffix"),
        F.col("length").alias("size_bytes"),
        F.round(F.col("length") / F.lit(1024 * 1024), 2).alias("size_mb"),
    )


def admit_files(
    listing: DataFrame,
    suffixes: Sequence[str] = tuple(FORMATS),
    max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """Add ``admitted`` and ``rejected_for`` by size and extension."""
    reason = F.when(F.col("size_bytes") > max_bytes, "too_large").when(
        ~F.col("suffix").isin(list(suffixes)), "unsupported_format"
    )
    return listing.withColumn("rejected_for", reason).withColumn("admitted", reason.isNull())


# A quoted field: its opening quote stands at the start of the line or after a comma.
# Possessive, so that a long field is matched in a loop and not by recursion.
_CLOSED_FIELD = r'(^|,)"(?:[^"]++|"")*+"(?=,|$)'
_OPEN_FIELD = r'(^|,)"'


def text_facts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per text file: first line, encoding, whether a record may span lines, lines, size.

    One splittable pass over the lines; every file is judged whole. ``spark.read.text`` keeps the
    bytes of a line as they are, so invalid UTF-8 can be seen; the first line is decoded with what
    was found. A record spans lines if a field that starts with a quote is not closed on its line;
    a quote inside a plain field means nothing. The first line is the one with the lowest number
    in the split that starts the file. The set of validity flags makes Spark aggregate in a hash
    table of objects; the string alone would make it sort all lines.
    """
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(list(paths))
        .select(
            "value",
            plain_path(F.col("_metadata.file_path")).alias("file_path"),
            F.col("_metadata.file_size").alias("file_size"),
            (F.col("_metadata.file_block_start") == 0).alias("at_start"),
            F.monotonically_increasing_id().alias("line"),
        )
    )
    opened = F.regexp_replace("value", _CLOSED_FIELD, "$1").rlike(_OPEN_FIELD)
    spans = F.contains("value", F.lit('"')) & opened
    encoding = F.when(F.array_contains("valid", False), LATIN1).otherwise(UTF8)
    header = F.when(encoding == LATIN1, F.decode(F.col("header").cast("binary"), "ISO-8859-1"))
    return (
        lines.groupBy("file_path")
        .agg(
            F.min_by("value", F.when(F.col("at_start"), F.col("line"))).alias("header"),
            F.collect_set(F.is_valid_utf8("value")).alias("valid"),
            F.bool_or(spans).alias("spans_lines"),
            F.count("*").alias("lines"),
            F.max("file_size").alias("size_bytes"),
        )
        .select(
            "file_path",
            header.otherwise(F.col("header")).alias("header"),
            encoding.alias("encoding"),
            "spans_lines",
            "lines",
            "size_bytes",
        )
    )


def header_columns(header: str) -> tuple[str, ...]:
    return tuple(next(csv.reader(io.StringIO(header.removeprefix("\ufeff"))), ()))


def _whole_header(spark: SparkSession, path: str, header: str, encoding: str) -> tuple[str, ...]:
    """Column names of a file; a header with a line end inside a cell is read as a record."""
    names = header_columns(header)
    if not re.search(_OPEN_FIELD, re.sub(_CLOSED_FIELD, r"\1", header)):
        return names
    options = {**CSV_OPTIONS, "header": "false", "multiLine": "true", "encoding": _SPARK_CHARSETS.get(encoding, encoding)}
    first = spark.read.options(**options).csv(path).first()
    return tuple((cell or "").removeprefix("\ufeff") for cell in first)


def _read_csv_group(
    spark: SparkSession,
    paths: list[str],
    columns: Sequence[str],
    encoding: str,
    multi_line: bool,
    misfit_col: str | None = None,
) -> DataFrame:
    names = _unique_names(columns) + ([misfit_col] if misfit_col else [])
    schema = _csv_schema(names)
    reader = (
        spark.read.options(**CSV_OPTIONS)
        .option("encoding", _SPARK_CHARSETS.get(encoding, encoding))
        .option("multiLine", str(multi_line).lower())
    )
    if misfit_col:
        # A scan that parses wanted columns only does not see how many fields a record has.
        reader = reader.option("columnNameOfCorruptRecord", misfit_col).option("columnPruning", "false")
    return reader.schema(schema).csv(paths)


def _csv_schema(names: Sequence[str]) -> str:
    return ", ".join(f"`{name.replace('`', '``')}` STRING" for name in names)


def _read_spanning_group(
    spark: SparkSession, paths: list[str], columns: Sequence[str], encoding: str, misfit_col: str | None = None
) -> DataFrame:
    names = _unique_names(columns) + ([misfit_col] if misfit_col else [])
    options = CSV_OPTIONS | ({"columnNameOfCorruptRecord": misfit_col} if misfit_col else {})
    rows = read_spanning(spark, paths, _csv_schema(names), options, _SPARK_CHARSETS.get(encoding, encoding), names)
    origin = [F.substring_index("_path", "/", -1).alias("source_file"), plain_path(F.col("_path")).alias("file_path")]
    return rows.select(*origin, *[F.col(f"`{name.replace('`', '``')}`") for name in names])


def _split_bytes(spark: SparkSession) -> int:
    """What Spark gives a task of a splittable file at most."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(unit or " ")


def _unique_names(columns: Sequence[str]) -> list[str]:
    """Spark needs distinct names: a nameless column gets its position, a repeat a number."""
    names: list[str] = []
    for position, name in enumerate(columns):
        name = name or f"Unnamed: {position}"
        repeat, wanted = 0, name
        while wanted in names:
            repeat += 1
            wanted = f"{name}.{repeat}"
        names.append(wanted)
    return names


def with_origin(df: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Put the file of origin first: its name and, to tell equal names apart, its path."""
    return df.select(
        F.col("_metadata.file_name").alias(file_col),
        plain_path(F.col("_metadata.file_path")).alias("file_path"),
        "*",
    )


def read_csv(
    spark: SparkSession,
    paths: Sequence[str],
    text_col: str = "text",
    columns: Sequence[str] | None = None,
    encoding: str | None = None,
    missing_text: str = "raise",
    facts: DataFrame | None = None,
    misfit_col: str | None = None,
    split_bytes: int | None = None,
    surplus_only: bool = False,
) -> DataFrame:
    """CSV files bound by header name, every column a string, file of origin first.

    Spark binds a schema to CSV columns by position, so files are grouped by their header (and by
    encoding) and each group is read with its own columns, then united by name. ``facts`` takes
    the result of an earlier ``text_facts``; files that are known to share one header and encoding
    can skip that pass altogether by passing both. ``misfit_col`` names a column that holds the
    record where it has more or fewer fields than the header, with ``surplus_only`` more fields only.

    How records end depends on a file's content alone, not on its size: a file in which a quoted
    field runs over a line end is read record by record, every other one by its lines and stays splittable.
    """
    paths = list(paths)
    if columns is not None and encoding is not None:
        if text_col not in columns:
            raise MissingColumnError(f"no column {text_col!r} in {paths[0]}")
        return with_origin(_read_csv_group(spark, paths, columns, encoding, True, misfit_col))
    facts = text_facts(spark, paths) if facts is None else facts
    groups = (
        facts.groupBy("header", "encoding", "spans_lines")
        .agg(F.sort_array(F.collect_list(F.struct("file_path", "size_bytes"))).alias("files"))
        .orderBy("header", "encoding", "spans_lines")
        .collect()
    )
    # Columns come out in the order in which the given files introduce them.
    place = {_bare(path): i for i, path in enumerate(paths)}
    groups = [({f["file_path"]: f["size_bytes"] for f in g["files"]}, g) for g in groups]
    groups.sort(key=lambda x: min(place.get(_bare(path), len(place)) for path in x[0]))
    bound = _split_bytes(spark) if split_bytes is None else split_bytes
    large = [p for sizes, g in groups if g["spans_lines"] for p in sizes if sizes[p] > bound]
    # A carriage return alone may end records, too; Spark's reader tells by the whole file.
    large = set(large) - files_with_returns(spark, large)
    parts = []
    for sizes, group in groups:
        members = list(sizes)
        charset = encoding or group["encoding"]
        names = _whole_header(spark, members[0], group["header"], charset)
        if text_col not in names:
            if missing_text == "raise":
                raise MissingColumnError(f"no column {text_col!r} in {members[0]}")
            continue
        in_parts, others = [p for p in members if p in large], [p for p in members if p not in large]
        found = []
        if others:
            found.append(with_origin(_read_csv_group(spark, others, names, charset, group["spans_lines"], misfit_col)))
        if in_parts:
            found.append(_read_spanning_group(spark, in_parts, names, charset, misfit_col))
        if misfit_col and surplus_only:
            surplus = F.when(n_fields(F.col(misfit_col)) > len(names), F.col(misfit_col))
            found = [rows.withColumn(misfit_col, surplus) for rows in found]
        parts += found
    if parts:
        return union_by_name(parts)
    empty = empty_comments(spark, text_col)
    return empty.withColumn(misfit_col, F.lit(None).cast("string")) if misfit_col else empty


def empty_comments(spark: SparkSession, text_col: str) -> DataFrame:
    return spark.createDataFrame(
        [], f"source_file STRING, file_path STRING, `{text_col}` STRING"
    )


def plain_path(path: Column) -> Column:
    """The path as it can be opened: row metadata spells it as an encoded URI."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def bare_path(path: Column) -> Column:
    """Path without a local scheme: listings and row metadata spell local URIs differently."""
    return F.regexp_replace(path, r"^file:/+", "/")


def _bare(path: str) -> str:
    return re.sub("^file:/+", "/", path)


def union_by_name(parts: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; a column a part lacks is null there."""
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part, allowMissingColumns=True)
    return united


def read_tables(
    spark: SparkSession,
    paths: Sequence[str],
    text_col: str = "text",
    missing_text: str = "raise",
    csv_facts: DataFrame | None = None,
    surplus_col: str | None = None,
) -> DataFrame:
    """Comments from CSV, JSON lines, Parquet and ORC files, with their file of origin.

    ``surplus_col`` names a column for the CSV records that have more fields than their header. A file that can't be read to its end fails the job; ``validate_files`` finds such files.
    """
    by_format: dict[str, list[str]] = {}
    for path in paths:
        by_format.setdefault(FORMATS[_suffix(path)], []).append(path)
    parts = []
    for kind, members in sorted(by_format.items()):
        if kind == "csv":
            parts.append(
                read_csv(
                    spark,
                    members,
                    text_col,
                    missing_text=missing_text,
                    facts=csv_facts,
                    misfit_col=surplus_col,
                    surplus_only=surplus_col is not None,
                )
            )
            continue
        table = _load(spark, kind, members)
        if text_col not in table.columns:
            if missing_text == "raise":
                raise MissingColumnError(f"no column {text_col!r} in {members[0]}")
            continue
        parts.append(with_origin(table))
    rows = union_by_name(parts) if parts else empty_comments(spark, text_col)
    if surplus_col and surplus_col not in rows.columns:
        rows = rows.withColumn(surplus_col, F.lit(None).cast("string"))
    return rows


def _load(spark: SparkSession, kind: str, paths: Sequence[str]) -> DataFrame:
    reader = spark.read.option("ignoreCorruptFiles", "false").option("recursiveFileLookup", "true")
    if kind in ("parquet", "orc"):
        reader = reader.option("mergeSchema", "true")
    return reader.format(kind).load(list(paths))


def _suffix(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""


def data_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(requested, file_path, bare, source_file, suffix, size_bytes)`` of the files below the paths.

    One listing; a file belongs to the path that is one of its ancestors, or itself.
    """
    steps = F.split("bare", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/")
    )
    found = list_files(spark, paths).withColumn("bare", bare_path(F.col("file_path")))
    asked = spark.createDataFrame(
        [(p, _bare(p).rstrip("/")) for p in dict.fromkeys(paths)], "requested STRING, ancestor STRING"
    )
    return (
        found.withColumn("ancestor", F.explode(ancestors))
        .join(asked, "ancestor")
        .select("requested", "file_path", "bare", "source_file", "suffix", "size_bytes")
    )


@dataclass(frozen=True)
class ValidatedFiles:
    """``report`` has one row per path that was handed in, ``files`` one per file found below them.

    ``rows`` is the scan of the good files (no copy is made of them), ``csv_facts`` describes the
    CSV files.
    """

    report: DataFrame
    rows: DataFrame
    csv_facts: DataFrame | None
    files: DataFrame


MISFIT = "_record_that_does_not_fit"
SURPLUS = "_record_with_surplus_fields"
_COUNTS = "bare STRING, n_rows BIGINT, n_texts BIGINT, n_misfits BIGINT"
OK, NO_DATA, NOT_FOUND, UNREADABLE = "ok", "no_data", "not_found", "unreadable"
MISSING_COLUMN, UNSUPPORTED = "missing_column", "unsupported_format"


def validate_files(
    spark: SparkSession, paths: Sequence[str], text_col: str = "text"
) -> ValidatedFiles:
    """Pre-check of every path: ``(file_path, source_file, status, n_rows)``.

    ``status`` is ``ok``, ``not_found``, ``unsupported_format``, ``missing_column``, ``no_data``
    or ``unreadable``; a folder of which some files are good and others lack the column or can't
    be read is ``partly_missing_column`` or ``partly_unreadable``. Rows are counted from the scan,
    in one job per format, in which all columns are read. A job that fails is repeated on halves
    of its files until the files that can't be read to their end are found; those have 0 rows.
    """
    paths = list(dict.fromkeys(paths))
    present = present_paths(spark, paths)
    listed = materialise(data_files(spark, present), "listing")
    by_format: dict[str, list[str]] = {}
    for row in listed.select("file_path", "suffix").distinct().orderBy("file_path").collect():
        if row["suffix"] in FORMATS:
            by_format.setdefault(FORMATS[row["suffix"]], []).append(row["file_path"])
    csv_paths = by_format.pop("csv", [])
    csv_facts, bad = _readable_facts(spark, csv_paths) if csv_paths else (None, [])
    csv_paths = [path for path in csv_paths if path not in set(bad)]
    counts, states = spark.createDataFrame([], _COUNTS), [(_bare(path), UNREADABLE) for path in bad]
    if csv_facts is not None:
        rows = read_csv(spark, csv_paths, text_col, missing_text="skip", facts=csv_facts, misfit_col=MISFIT)
        counts = counts.unionByName(_counted(rows, text_col))
        states += _csv_states(spark, csv_facts, text_col)
    for kind, members in by_format.items():
        found, bad = _count_readable(spark, kind, members, text_col)
        counts = counts.unionByName(found)
        states += [(_bare(path), UNREADABLE) for path in bad]
    counts = materialise(counts, "file-counts")
    silent = [r["bare"] for r in counts.filter("n_texts = 0").select("bare").collect()]
    for kind, members in by_format.items():
        quiet = [p for p in members if _bare(p) in set(silent)]
        states += [(_bare(path), MISSING_COLUMN) for path in _lacking(spark, kind, quiet, text_col)]
    known = spark.createDataFrame(states, "bare STRING, state STRING")
    encodings = (
        csv_facts.select(bare_path(F.col("file_path")).alias("bare"), "encoding")
        if csv_facts is not None
        else spark.createDataFrame([], "bare STRING, encoding STRING")
    )
    n_rows = F.coalesce("n_rows", F.lit(0))
    files = materialise(
        listed.join(counts, "bare", "left")
        .join(known, "bare", "left")
        .join(encodings, "bare", "left")
        .select(
            "requested",
            "file_path",
            "bare",
            "source_file",
            F.when(~F.col("suffix").isin(list(FORMATS)), UNSUPPORTED)
            .when(F.col("state").isNotNull(), F.col("state"))
            .when(n_rows == 0, NO_DATA)
            .otherwise(OK)
            .alias("status"),
            n_rows.alias("n_rows"),
            F.coalesce("n_misfits", F.lit(0)).alias("n_misfits"),
            "size_bytes",
            F.coalesce("encoding", F.lit("unknown")).alias("encoding"),
        ),
        "files",
    )
    asked = spark.createDataFrame([(p, p in set(present)) for p in paths], "file_path STRING, found BOOLEAN")
    report = asked.join(_by_request(files), asked["file_path"] == F.col("requested"), "left").select(
        "file_path",
        file_name(F.col("file_path")).alias("source_file"),
        F.when(~F.col("found"), NOT_FOUND).otherwise(F.coalesce("status", F.lit(NO_DATA))).alias("status"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )
    good = [r["file_path"] for r in files.filter(F.col("status") == OK).select("file_path").distinct().orderBy("file_path").collect()]
    if csv_facts is None or not good:
        kept = csv_facts
    else:
        fine = files.filter(F.col("status") == OK).select("bare").distinct()
        kept = csv_facts.join(fine, bare_path(F.col("file_path")) == F.col("bare"), "left_semi")
    rows = read_tables(spark, good, text_col, "skip", kept) if good else empty_comments(spark, text_col)
    return ValidatedFiles(report, rows, csv_facts, files)


def _by_request(files: DataFrame) -> DataFrame:
    """Status and rows of a requested path from those of its files."""
    has = lambda status: F.bool_or(F.col("status") == status)
    some = has(OK)
    return files.groupBy("requested").agg(
        F.when(has(UNREADABLE), F.when(some, f"partly_{UNREADABLE}").otherwise(UNREADABLE))
        .when(has(MISSING_COLUMN), F.when(some, f"partly_{MISSING_COLUMN}").otherwise(MISSING_COLUMN))
        .when(some, OK)
        .when(has(NO_DATA), NO_DATA)
        .otherwise(UNSUPPORTED)
        .alias("status"),
        F.sum("n_rows").alias("n_rows"),
    )


def _counted(rows: DataFrame, text_col: str) -> DataFrame:
    """Rows per file of a scan with its origin; the hash makes the scan read every column."""
    others = [f.name for f in rows.schema if f.name not in ("source_file", "file_path")]
    hashed = [F.col(f"`{f.name}`") for f in rows.schema if f.name in others and "map<" not in f.dataType.simpleString()]
    misfits = F.count(MISFIT) if MISFIT in rows.columns else F.lit(0).cast("bigint")
    texts = F.count(f"`{text_col}`") if text_col in others else F.lit(0).cast("bigint")
    return (
        rows.groupBy(bare_path(F.col("file_path")).alias("bare"))
        .agg(
            F.count("*").alias("n_rows"),
            texts.alias("n_texts"),
            misfits.alias("n_misfits"),
            F.max(F.xxhash64(*hashed)).alias("read"),
        )
        .filter("read IS NOT NULL")
        .drop("read")
    )


def _count_readable(
    spark: SparkSession, kind: str, paths: list[str], text_col: str
) -> tuple[DataFrame, list[str]]:
    """Counts of the files that can be read to their end, and the other files."""
    try:
        return materialise(_counted(with_origin(_load(spark, kind, paths)), text_col), "counted"), []
    except Exception:  # any failure to read a file is that file's status
        if len(paths) == 1:
            return spark.createDataFrame([], _COUNTS), list(paths)
    middle = len(paths) // 2
    left, bad_left = _count_readable(spark, kind, paths[:middle], text_col)
    right, bad_right = _count_readable(spark, kind, paths[middle:], text_col)
    return left.unionByName(right), bad_left + bad_right


def _lacking(spark: SparkSession, kind: str, paths: list[str], text_col: str) -> list[str]:
    """Files without the text column, judged by the common schema of ever smaller groups."""
    if not paths or text_col not in _load(spark, kind, paths).columns:
        return list(paths)
    if len(paths) == 1:
        return []
    middle = len(paths) // 2
    return _lacking(spark, kind, paths[:middle], text_col) + _lacking(spark, kind, paths[middle:], text_col)


def _readable_facts(spark: SparkSession, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """``text_facts`` of the files that can be read to their end, and the other files."""
    try:
        return materialise(text_facts(spark, paths), "csv-facts"), []
    except Exception:  # any failure to read a file is that file's status
        if len(paths) == 1:
            return None, list(paths)
    middle = len(paths) // 2
    left, bad_left = _readable_facts(spark, paths[:middle])
    right, bad_right = _readable_facts(spark, paths[middle:])
    found = [facts for facts in (left, right) if facts is not None]
    return union_by_name(found) if found else None, bad_left + bad_right


def csv_states(spark: SparkSession, paths: Sequence[str], text_col: str) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Facts of the CSV files that can be used, and ``(path, status)`` of those that can't: they have gone,
    can't be read to their end or lack the column."""
    paths = list(paths)
    present = present_paths(spark, paths)
    states = [(path, NOT_FOUND) for path in paths if path not in set(present)]
    facts, bad = _readable_facts(spark, present) if present else (None, [])
    states += [(path, UNREADABLE) for path in bad]
    if facts is None:
        return None, states
    lacking = dict(_csv_states(spark, facts, text_col))
    if not lacking:
        return facts, states
    out = spark.createDataFrame([(bare,) for bare in lacking], "bare STRING")
    usable = facts.join(out, bare_path(F.col("file_path")) == F.col("bare"), "left_anti")
    return usable, states + [(path, lacking[_bare(path)]) for path in paths if _bare(path) in lacking]


def _csv_states(spark: SparkSession, csv_facts: DataFrame, text_col: str) -> list[tuple[str, str]]:
    """CSV files whose header lacks the text column; headers are judged once each."""
    seen = csv_facts.groupBy("header", "encoding").agg(F.min("file_path").alias("path")).collect()
    lacking = [
        (r["header"], r["encoding"])
        for r in seen
        if text_col not in _whole_header(spark, r["path"], r["header"], r["encoding"])
    ]
    if not lacking:
        return []
    named = spark.createDataFrame(lacking, "header STRING, encoding STRING")
    found = csv_facts.join(named, ["header", "encoding"], "left_semi")
    return [(r["bare"], MISSING_COLUMN) for r in found.select(bare_path(F.col("file_path")).alias("bare")).collect()]


def probe_encodings(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """``(source_file, encoding)``: utf-8 if every line of the file is valid UTF-8."""
    return text_facts(spark, paths).select(
        file_name(F.col("file_path")).alias("source_file"), "encoding", "lines"
    )


def preview(df: DataFrame, order_by: str, rows: int = 10) -> DataFrame:
    return df.orderBy(order_by).limit(rows)


__all__ = [
    "admit_files",
    "data_files",
    "list_files",
    "preview",
    "probe_encodings",
    "read_csv",
    "read_tables",
    "text_facts",
    "union_by_name",
    "validate_files",
]

"""Bulk light-curve file ingest (FITS binary tables) as a Spark job.

Files are listed and read by Spark's ``binaryFile`` source (one row per file,
partitions packed up to ``spark.sql.files.maxPartitionBytes``); each file's
records are decoded with NumPy inside ``mapInArrow``, the rows of many files to one
Arrow batch.  Only the primary header and the first binary-table extension are
read.  A file that cannot be parsed, or lacks TIME or a flux column, becomes one
error row instead of failing the job.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from starlit.sources.columns import OBSERVED, resolve_observed
from starlit.sources.storage import path_exists

BLOCK = 2880
CARD = 80
BATCH_ROWS = 50_000      # rows of decoded files in one Arrow batch, or one file's if it has more
CACHED_CARDS = 4096      # files of one instrument repeat most header cards
CACHED_LAYOUTS = 256

# Fixed values of the light-curve file layout: header keys of the object id and quarter, and the
# prefix that file names put before the object id.
OBJECT_KEY = "KEPLERID"
QUARTER_KEY = "QUARTER"
NAME_PREFIX = "kplr"

INGEST_SCHEMA = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("source_file", T.StringType()),
    T.StructField("object_id", T.StringType()),
    T.StructField("quarter", T.IntegerType()),
    T.StructField("time", T.DoubleType()),
    T.StructField("flux", T.DoubleType()),
    T.StructField("flux_err", T.DoubleType()),
    T.StructField("quality", T.DoubleType()),
    T.StructField("error", T.StringType()),
])

# What the decoder returns per row: values, and the header texts that ids and quarters are derived from.
_HEADER_FIELDS = {"object_1": (0, OBJECT_KEY), "object_2": (1, OBJECT_KEY),
                  "quarter_1": (0, QUARTER_KEY), "quarter_2": (1, QUARTER_KEY)}
DECODED_SCHEMA = T.StructType(
    [INGEST_SCHEMA["dataset"], INGEST_SCHEMA["source_file"]]
    + [T.StructField(c, T.StringType()) for c in _HEADER_FIELDS]
    + [T.StructField(c, T.DoubleType()) for c in OBSERVED] + [INGEST_SCHEMA["error"]])

# Bytes of column types that no observation column uses: complex numbers and array descriptors.
_UNUSED_FORMS = {"C": 8, "M": 16, "P": 8, "Q": 16}
_FORMS = {"L": ("i1", 1), "B": ("u1", 1), "I": (">i2", 2), "J": (">i4", 4), "K": (">i8", 8),
          "E": (">f4", 4), "D": (">f8", 8)}


# --- header ---------------------------------------------------------------------------------
def _card_value(text: str):
    s = text.strip()
    if s.startswith("'"):
        out, i = [], 1
        while i < len(s):
            if s[i] == "'":
                if i + 1 < len(s) and s[i + 1] == "'":
                    out.append("'")
                    i += 2
                    continue
                break
            out.append(s[i])
            i += 1
        return "".join(out).rstrip()
    s = s.split("/", 1)[0].strip()
    if s in ("T", "F"):
        return s == "T"
    if not s:
        return None
    try:
        return int(s)
    except ValueError:
        pass
    try:
        return float(s.replace("D", "E"))
    except ValueError:
        return s


@lru_cache(maxsize=CACHED_CARDS)
def _read_card(card: str) -> tuple:
    """(key, has it a value, value) of a header card."""
    given = card[8:10] == "= "
    return card[:8].strip().upper(), given, _card_value(card[10:]) if given else None


def read_header(buf: bytes, offset: int) -> tuple[dict, int]:
    """Header cards from ``offset`` up to END; returns (cards, offset of the data)."""
    cards: dict = {}
    pos = offset
    while True:
        if pos + BLOCK > len(buf):
            raise ValueError("truncated header")
        block = buf[pos:pos + BLOCK].decode("ascii", errors="replace")
        pos += BLOCK
        for i in range(0, BLOCK, CARD):
            key, given, value = _read_card(block[i:i + CARD])
            if key == "END":
                return cards, pos
            if given:
                cards.setdefault(key, value)


def _padded(n: int) -> int:
    return (n + BLOCK - 1) // BLOCK * BLOCK


@lru_cache(maxsize=CACHED_LAYOUTS)
def _layout(columns: tuple[tuple[str, str], ...]) -> tuple[np.dtype, list[tuple[int, str]], int]:
    """(record type, [(number, name) of its columns], bytes of a row) of the (TFORM, TTYPE) of a table's columns."""
    layout, names, offset = [], [], 0
    for k, (form, name) in enumerate(columns, start=1):
        form = form.strip().upper()
        m = re.match(r"^(\d*)([A-Z])", form)
        if not m:
            raise ValueError(f"bad TFORM{k}: {form}")
        repeat, code = int(m.group(1) or 1), m.group(2)
        if code == "A":
            layout.append((f"c{k}", f"S{repeat}", offset))
            offset += repeat
        elif code in _FORMS:
            dt, width = _FORMS[code]
            layout.append((f"c{k}", dt if repeat == 1 else (dt, (repeat,)), offset))
            offset += width * repeat
        elif code == "X" or code in _UNUSED_FORMS:
            offset += (repeat + 7) // 8 if code == "X" else repeat * _UNUSED_FORMS[code]
            continue
        else:
            raise ValueError(f"unsupported TFORM{k}: {form}")
        names.append((k, name.strip()))
    dtype = np.dtype({"names": [x[0] for x in layout], "formats": [x[1] for x in layout],
                      "offsets": [x[2] for x in layout], "itemsize": offset})
    return dtype, names, offset


def read_table(buf: bytes) -> tuple[dict, dict, dict]:
    """(primary header, table header, {COLUMN NAME: float64 array}) of the first binary table."""
    primary, pos = read_header(buf, 0)
    if primary.get("SIMPLE") is not True:
        raise ValueError("not a FITS file")
    naxis = primary.get("NAXIS", 0) or 0
    size = 0
    if naxis:
        size = abs(primary.get("BITPIX", 8)) // 8
        for k in range(1, naxis + 1):
            size *= primary.get(f"NAXIS{k}", 0)
    pos += _padded(size)
    table, data_at = read_header(buf, pos)
    if str(table.get("XTENSION", "")).strip().upper() != "BINTABLE":
        raise ValueError("extension 1 is not a binary table")
    row_bytes, rows, fields = table["NAXIS1"], table["NAXIS2"], table["TFIELDS"]
    dtype, names, size = _layout(tuple((str(table[f"TFORM{k}"]), str(table.get(f"TTYPE{k}", f"COL{k}"))) for k in range(1, fields + 1)))
    if size != row_bytes:
        raise ValueError(f"row size {size} does not match NAXIS1 {row_bytes}")
    if data_at + row_bytes * rows > len(buf):
        raise ValueError("truncated table data")
    rec = np.frombuffer(buf, dtype=dtype, count=rows, offset=data_at)
    columns = {}
    for k, name in names:
        raw = rec[f"c{k}"]
        if raw.dtype.kind == "S" or raw.ndim != 1:
            continue
        values = raw.astype("float64")
        null = table.get(f"TNULL{k}")
        if null is not None and raw.dtype.kind in "iu":
            values[raw == null] = np.nan
        scale, zero = table.get(f"TSCAL{k}", 1.0), table.get(f"TZERO{k}", 0.0)
        if scale != 1.0 or zero != 0.0:
            values = values * scale + zero
        columns.setdefault(name.upper(), values)
    return primary, table, columns


def decode_file(content: bytes, name: str) -> dict:
    """Observation values of one light-curve file, with its header texts; raises on unusable files."""
    primary, table, columns = read_table(content)
    found = resolve_observed(columns, f"file {name}")
    rows = len(columns[found["time"]])
    values = {target: columns[source] if source else np.full(rows, np.nan if OBSERVED[target].absent is None else OBSERVED[target].absent)
              for target, source in found.items()}
    headers = {field: (primary, table)[which].get(key) for field, (which, key) in _HEADER_FIELDS.items()}
    return values | {field: None if v is None else str(v) for field, v in headers.items()}


def _decoded(files: list[tuple[dict, int]]) -> pa.RecordBatch:
    """The rows of decoded files, (values by column, rows) each, as one batch."""
    of_row = pa.array(np.repeat(np.arange(len(files)), [rows for _, rows in files]))
    columns = []
    for f in DECODED_SCHEMA.fields:
        if isinstance(f.dataType, T.StringType):
            columns.append(pa.array([found.get(f.name) for found, _ in files], pa.string()).take(of_row))
        else:  # a missing value is NaN in a file and NULL in a row
            values = [found[f.name] if f.name in found else np.full(rows, np.nan) for found, rows in files]
            columns.append(pa.array(np.concatenate(values), pa.float64(), from_pandas=True))
    return pa.RecordBatch.from_arrays(columns, names=DECODED_SCHEMA.names)


def _decode_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    files, held = [], 0
    for batch in batches:
        for path, content, dataset in zip(*(batch.column(c) for c in ("path", "content", "dataset"))):
            name = os.path.basename(str(path.as_py()))
            try:
                found = decode_file(bytes(content.as_py()), name)
                rows = len(found["time"])
            except Exception as exc:  # noqa: BLE001 - one bad file is one error row
                found, rows = {"error": str(exc) or type(exc).__name__}, 1
            files.append((found | {"dataset": dataset.as_py(), "source_file": name}, rows))
            held += rows
            if held >= BATCH_ROWS:
                yield _decoded(files)
                files, held = [], 0
    if files:
        yield _decoded(files)


def _given(text) -> F.Column:
    """A header text, or NULL where the header says nothing: absent, empty, zero or false."""
    return F.when(~F.trim(text).isin("", "0", "0.0", "False"), text)


def header_object_id() -> F.Column:
    """Object id: primary header, table header, else the file name up to its first '-', without the prefix."""
    stem = F.regexp_replace("source_file", r"\.[^.]*$", "")
    from_name = F.replace(F.substring_index(stem, "-", 1), F.lit(NAME_PREFIX), F.lit(""))
    return F.coalesce(_given(F.col("object_1")), _given(F.col("object_2")), from_name)


def header_quarter(keep_zero: bool) -> F.Column:
    """Quarter as a whole number: primary header, else table header; -1 when there is none. A header zero
    counts as none unless ``keep_zero``."""
    first, second = (F.col(c) if keep_zero else _given(F.col(c)) for c in ("quarter_1", "quarter_2"))
    text = F.coalesce(first, second)
    return F.coalesce(F.when(text.rlike(r"^-?[0-9]+$"), text.try_cast("int")), F.lit(-1))


def parse_light_curves(files: DataFrame, keep_zero_quarter: bool = False) -> DataFrame:
    """(path, content, dataset) rows -> observation rows plus an ``error`` column."""
    decoded = files.select("path", "content", "dataset").mapInArrow(_decode_batches, DECODED_SCHEMA)
    fine = F.col("error").isNull()
    return decoded.withColumns({"object_id": F.when(fine, header_object_id()),
                                "quarter": F.when(fine, header_quarter(keep_zero_quarter))}).select(*INGEST_SCHEMA.names)


FITS_GLOB = "*.{fits,FITS}"


def list_files(spark: SparkSession, datasets: dict[str, str], with_content: bool = True) -> DataFrame | None:
    """Light-curve files of every dataset directory (each file once), tagged with the dataset."""
    parts = []
    for name, directory in datasets.items():
        if not path_exists(spark, directory):
            continue
        df = spark.read.format("binaryFile").option("pathGlobFilter", FITS_GLOB).load(directory)
        cols = ["path", "length"] + (["content"] if with_content else [])
        parts.append(df.select(*cols).withColumn("dataset", F.lit(name)))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_light_curves(spark: SparkSession, datasets: dict[str, str], keep_zero_quarter: bool = False) -> DataFrame:
    files = list_files(spark, datasets)
    if files is None:
        return spark.createDataFrame([], INGEST_SCHEMA)
    return parse_light_curves(files, keep_zero_quarter)


def good_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull()).drop("error")


def error_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNotNull()).select("dataset", F.col("source_file").alias("file"), "error")


def file_inventory(spark: SparkSession, files: DataFrame | None, datasets: list[str]) -> DataFrame:
    """File count per dataset; datasets without files get 0 and status 'no_files'."""
    names = spark.createDataFrame([(d,) for d in datasets], "dataset string")
    if files is None:
        counts = spark.createDataFrame([], "dataset string, fits_files long")
    else:
        counts = files.groupBy("dataset").agg(F.count(F.lit(1)).alias("fits_files"))
    out = names.join(counts, "dataset", "left").withColumn("fits_files", F.coalesce("fits_files", F.lit(0)).cast("long"))
    return out.withColumn("status", F.when(F.col("fits_files") == 0, F.lit("no_files")).otherwise(F.lit("listed")))

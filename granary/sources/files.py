"""File sources and sinks: semicolon CSV with a byte-order mark, JSON, Parquet, small JSON documents."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators.prefix import running_sums
from .lineage import cut, small

RAW = ["dt_text", "category", "item", "item_name", "branch", "unit", "qty_text"]
OUTLETS = ["outlet", "address", "district", "city", "has_shopee", "has_gofood", "has_grabfood"]
OVERRIDES = ["branch", "outlet", "city_override"]
REGIONS = ["old_name", "branch", "address", "district", "city", "has_shopee", "has_gofood", "has_grabfood", "region", "ship_text"]
#: The files' header lines.
RAW_HEADER = ["Tanggal", "Kategori Barang", "Kode Barang", "Nama Barang", "Nama Cabang", "Satuan", "Kuantitas"]
OUTLET_HEADER = ["Nama Outlet", "Alamat", "Kecamatan", "Kota", "has_shopee", "has_gofood", "has_grabfood"]
OVERRIDE_HEADER = ["Nama Cabang", "Nama Outlet", "Kota Override"]
REGION_HEADER = ["old_name", "new_name", "Alamat", "Kecamatan", "Kota", "has_shopee", "has_gofood", "has_grabfood", "kawasan", "hari_pengiriman"]
CLOSURE_HEADER = ["Nama Outlet", "tanggal_tutup", "tanggal_buka", "alasan"]
EVENT_ITEM_HEADER = ["prioritas_cek", "Kode Barang", "Nama Barang", "Kategori Barang", "is_event_driven", "catatan", "pct_hari_nol", "adi_rata2", "rata2_saat_bergerak", "jml_cabang", "total_kuantitas"]
EVENT_ITEMS = ["check_order", "item", "item_name", "category", "is_event_driven", "note", "zero_pct", "adi", "mean_qty", "n_branches", "total_qty"]


def csv(spark: SparkSession, path: str, header: list[str], columns: list[str]) -> DataFrame:
    """All-text columns of semicolon CSV files, found by the names in their header lines.

    header: the file's name of each column; all must be there, in any order, and others are
    left out. A folder's files must have the same header line. A byte-order mark is dropped.
    """
    raw = spark.read.csv(path, sep=";", header=True, inferSchema=False, enforceSchema=False)
    names = {c.removeprefix("\ufeff").strip(): c for c in raw.columns}
    if missing := [h for h in header if h not in names]:
        raise ValueError(f"{path} has no column {missing}; its header is {raw.columns}")
    return raw.select(*[F.col(f"`{names[h]}`").alias(c) for h, c in zip(header, columns, strict=True)])


def _field_count(line: Column) -> Column:
    return F.size(F.split(F.regexp_replace(line, '"[^"]*"', ""), ";"))


def in_line_order(lines: DataFrame) -> DataFrame:
    """`lines` with `at`, their number over all files in the order of file_no, path and place in the file.

    lines: file_no, path, block (where the line's split begins in the file) and nth (rising in
    a split by one a line, as monotonically_increasing_id is). Spark reads splits in any order,
    large ones first; each split is numbered from the sizes of those before it.
    """
    split = ["file_no", "path", "block"]
    held = cut(lines)
    sizes = held.groupBy(*split).agg(F.count("*").alias("n"), F.min("nth").alias("least"))
    begins = running_sums(sizes, split, {"upto": F.col("n")}).select(*split, (F.col("upto") - F.col("n") - F.col("least")).alias("shift"))
    return held.join(small(cut(begins)), split).select("value", "file_no", (F.col("shift") + F.col("nth")).alias("at"))


def transactions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Raw rows with their order (file_no in `paths`, at within it): item, branch, dt, qty and texts.

    A path is a file or a folder of files, whose order is that of their names; each has the
    header line of RAW_HEADER, which the reader drops where a file begins. `at` numbers the
    lines of all paths in their order. Fields may be quoted. Wholly blank lines are dropped. A
    line of too few fields, or with a non-blank field after the last, or with a bad date raises.
    """
    lines = None
    for i, p in enumerate(paths):
        # one field a line: a separator and a quote that no text file holds; its name is the header line, which all files must share
        one = spark.read.csv(p, sep="\x01", quote="\x02", escape="\x02", header=True, enforceSchema=False)
        header = one.columns[0] if one.columns else ""
        if [h.strip(' \ufeff"') for h in header.split(";")][: len(RAW)] != RAW_HEADER:
            raise ValueError(f"{p} must begin with the columns {RAW_HEADER}, not {header!r}")
        one = one.select(F.col("`" + header.replace("`", "``") + "`").alias("value"), F.lit(i).alias("file_no"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"))
        lines = one if lines is None else lines.unionByName(one)
    lines = in_line_order(lines)
    lines = lines.withColumn("value", F.regexp_replace("value", "\r$", "")).where(F.regexp_replace("value", '[;"\\s]', "") != "")
    extra = F.regexp_replace(F.regexp_replace("value", '"[^"]*[^"\\s][^"]*"', "q"), '"\\s*"', "")
    after = F.split(extra, ";")
    good = (_field_count(F.col("value")) >= len(RAW)) & ~F.exists(F.slice(after, len(RAW) + 1, F.greatest(F.size(after), F.lit(1))), lambda c: F.trim(c) != "")
    checked = F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("bad line: "), F.col("value"))).cast("string"))
    cells = lines.select("file_no", "at", F.from_csv(checked, ", ".join(f"`{c}` string" for c in RAW), {"sep": ";", "escape": '"'}).alias("f"))
    rows = cells.select("file_no", "at", *[T.strip_ends(F.coalesce(F.col("f")[c], F.lit(""))).alias(c) for c in RAW])
    dt = F.try_to_date("dt_text", "d MMM yyyy")
    dt = F.coalesce(dt, F.raise_error(F.concat(F.lit("bad date: "), F.col("dt_text"))).cast("date"))
    return rows.select(dt.alias("dt"), *RAW[1:-1], T.parse_quantity(F.col("qty_text")).alias("qty"), "file_no", "at", "dt_text", "qty_text")


def merge_and_sort(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of all files by date; rows of a day keep the order of the files and of their lines."""
    return transactions(spark, paths).orderBy("dt", "at")


def outlets(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, OUTLET_HEADER, OUTLETS)


def outlets_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects with the outlet file's header names."""
    names = OUTLET_HEADER
    rows = spark.read.json(path, multiLine=True)
    if extra := set(rows.columns) - set(names):
        raise ValueError(f"unknown outlet fields {sorted(extra)}")
    return rows.select(*[F.col(f"`{a}`").cast("string").alias(b) for a, b in zip(names, OUTLETS, strict=True)])


def overrides(spark: SparkSession, path: str) -> DataFrame:
    return csv(spark, path, OVERRIDE_HEADER, OVERRIDES)


def regions(spark: SparkSession, path: str) -> DataFrame:
    out = csv(spark, path, REGION_HEADER, REGIONS)
    return out.withColumns({"region": F.col("region").cast("int"), "ship_days": T.delivery_days(F.col("ship_text"))})


def _file(spark: SparkSession, path: str):
    """(file system, path) by Hadoop, so that a path means the same to the driver and the executors."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _file(spark, path)
    return fs.exists(at)


def closures(spark: SparkSession, path: str) -> DataFrame:
    """(branch, start_dt, end_dt, reason); an absent file is empty; bad, inverted or overlapping intervals raise."""
    if not exists(spark, path):
        return spark.createDataFrame([], "branch string, start_dt date, end_dt date, reason string")
    raw = csv(spark, path, CLOSURE_HEADER, ["branch", "start_text", "end_text", "reason"]).where("branch is not null")
    end_text = F.nullif(T.strip_ends(F.coalesce("end_text", F.lit(""))), F.lit(""))
    out = raw.select("branch", F.try_to_date("start_text").alias("start_dt"), F.try_to_date(end_text).alias("end_dt"), end_text.alias("e"), "reason")
    later = F.lead("start_dt").over(Window.partitionBy("branch").orderBy("start_dt"))
    bad = F.col("start_dt").isNull() | (F.col("e").isNotNull() & F.col("end_dt").isNull()) | (F.col("end_dt") <= F.col("start_dt"))
    clash = F.col("later").isNotNull() & (F.col("end_dt").isNull() | (F.col("later") < F.col("end_dt")))
    wrong = out.withColumn("later", later).where(F.coalesce(bad, F.lit(False)) | clash).select("branch").distinct().collect()
    if wrong:
        raise ValueError(f"bad closures of {sorted(r.branch for r in wrong)}")
    return out.drop("e")


def event_items(spark: SparkSession, path: str) -> DataFrame:
    out = csv(spark, path, EVENT_ITEM_HEADER, EVENT_ITEMS)
    return out.withColumn("is_event_driven", T.truth(F.col("is_event_driven")))


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolon CSV with a header; never over a path that the frame reads."""
    df.write.mode("overwrite").csv(path, sep=";", header=True)


def write_sorted(df: DataFrame, header: list[str], path: str, order: list[str] = ()) -> None:
    """Semicolon CSV files with a byte-order mark and a header line each; read in the order of their names they follow `order`.

    df: one text column for each name in `header`, and the columns of `order`. A field with a
    separator, a quote or a line end is quoted.
    """
    names = [c for c in df.columns if c not in order]
    if len(names) != len(header):
        raise ValueError(f"{len(header)} columns are needed, not {names}")
    rows = df.orderBy(*order) if order else df
    out = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(h) for c, h in zip(names, header, strict=True)])
    out = out.withColumnRenamed(header[0], "\ufeff" + header[0])
    out.write.mode("overwrite").csv(path, sep=";", header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_outlets(df: DataFrame, path: str) -> None:
    """Outlets in the file's field order; a missing or an unknown column raises."""
    if set(df.columns) != set(OUTLETS):
        raise ValueError(f"outlet fields {sorted(set(df.columns) ^ set(OUTLETS))} are missing or unknown")
    write_sorted(df.select(*OUTLETS), OUTLET_HEADER, path)


def merge_files(spark: SparkSession, paths: list[str], path: str) -> None:
    """All files' rows by date as one set of CSV files; texts as they were."""
    rows = transactions(spark, paths).select("dt_text", *RAW[1:-1], "qty_text", "dt", "at")
    write_sorted(rows, RAW_HEADER, path, ["dt", "at"])


def aggregate_files(spark: SparkSession, source: str, path: str) -> None:
    """Merged rows with those alike in all but the quantity summed, to one decimal, in the order of their first lines; not over `source`."""
    if source.rstrip("/") == path.rstrip("/"):
        raise ValueError("a table can't be written over what it is read from")
    rows = transactions(spark, [source])
    keys = ["dt_text", *RAW[1:-1]]
    out = rows.groupBy(*keys).agg(F.bround(F.sum("qty"), 1).cast("string").alias("qty_text"), F.min("at").alias("at"))
    write_sorted(out, RAW_HEADER, path, ["at"])


def sync_outlets(spark: SparkSession, source: str, path: str) -> None:
    """Outlets from JSON to CSV."""
    write_outlets(outlets_json(spark, source), path)


def write_monthly(df: DataFrame, path: str) -> None:
    """Parquet by month of dt."""
    df.withColumn("ym", F.date_format("dt", "yyyy-MM")).write.mode("overwrite").partitionBy("ym").parquet(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small file, replaced as a whole."""
    fs, at = _file(spark, path)
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file; what a stream has left over is not there any more, so a whole read."""
    return "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """Small results (mappings, scalers, parameters) with sorted keys."""
    write_text(spark, json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False), path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(read_text(spark, path))


def mapping_to_json(mapping: DataFrame, path: str) -> None:
    out: dict[str, dict[str, int]] = {}
    for r in mapping.collect():
        out.setdefault(r.col, {})[r.value] = r.idx
    write_json(mapping.sparkSession, out, path)


def mapping_from_json(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved (col, value, idx), or None without a file."""
    if not exists(spark, path):
        return None
    rows = [(c, v, int(i)) for c, m in read_json(spark, path).items() for v, i in m.items()]
    return spark.createDataFrame(rows, "col string, value string, idx int")

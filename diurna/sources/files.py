"""Readers and writers for raw exports."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Encodings tried in this order.
ENCODINGS = ("utf-8", "MS949", "EUC-KR")
CODECS = ("utf-8", "cp949", "euc_kr")  # Python's names
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared folder named by spark.checkpoint.dir.

    Without that setting a temporary folder is used on a local master only; on a cluster executors
    would not see each other's files, so it is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get("dir")
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = _LOCAL["dir"] = tempfile.mkdtemp(prefix="diurna-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's file systems, wherever it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def headers(spark: SparkSession, path) -> dict[str, list[str]]:
    """Files by header line. One small row per file (the driver holds the file list anyway)."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    first = lines.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    groups: dict[str, list[str]] = {}
    for r in first.toLocalIterator():
        groups.setdefault(r.header, []).append(r.file)
    return groups


def quoted_records(spark: SparkSession, path) -> DataFrame:
    """(file, record): the CSV records of UTF-8 files whose quoted fields may hold newlines, headers left out.

    Large files stay split. A line starts a record if an even number of quotes precedes it in its
    file: each block of lines counts its quotes, a prefix sum over the blocks (a row per block)
    tells whether a block starts inside quotes, and a window inside the block does the rest. Lines
    that are whole records pass; only those of records over several lines are brought together.
    Quotes stand around fields and doubled inside them (RFC 4180), nowhere else; an unclosed quote
    makes one record of the rest of its file, as it does for any reader.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    lines = lines.withColumn("quotes", F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'))))
    upto = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = lines.withColumn("before", F.coalesce(F.sum("quotes").over(upto), F.lit(0)))
    blocks = lines.groupBy("file", "block").agg(F.sum("quotes").alias("q"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = blocks.select("file", "block", F.coalesce(F.sum("q").over(earlier), F.lit(0)).alias("carried"))
    marked = inside.join(opened, ["file", "block"]).withColumn("starts", (F.col("before") + F.col("carried")) % 2 == 0)
    whole = marked.where(F.col("starts") & (F.col("quotes") % 2 == 0)).select("file", "block", "at", F.col("value").alias("record"))
    # the other lines belong to the last start before them, in this block or an earlier one
    torn = marked.where(~F.col("starts") | (F.col("quotes") % 2 == 1))
    own = F.when(F.col("starts"), F.struct("block", "at"))
    held = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    torn = torn.withColumn("own", F.last(own, ignorenulls=True).over(held))
    last = torn.groupBy("file", "block").agg(F.max(own).alias("own_last"))
    before = last.select("file", "block", F.last("own_last", ignorenulls=True).over(earlier).alias("left"))
    keyed = torn.join(before, ["file", "block"]).withColumn("key", F.coalesce("own", "left"))
    parts = F.array_sort(F.collect_list(F.struct("block", "at", "value")))
    joined = keyed.groupBy("file", "key").agg(F.array_join(F.transform(parts, lambda x: x["value"]), "\n").alias("record"))
    records = whole.unionByName(joined.select("file", F.col("key.block").alias("block"), F.col("key.at").alias("at"), "record"))
    first = lines.groupBy("file").agg(F.min(F.struct("block", "at")).alias("first"))
    body = records.join(first, "file").where(F.struct("block", "at") != F.col("first")).select("file", F.rtrim("record", F.lit("\r")).alias("record"))
    return body.where("record <> ''")


def _read_quoted(spark: SparkSession, found: list[str], header: str) -> DataFrame:
    """The records of files that share a header, as text columns."""
    names = spark.createDataFrame([(header.rstrip("\r"),)], "h string")
    sample = names.select(F.schema_of_csv(F.lit(header.rstrip("\r")), {"quote": '"', "escape": '"'})).first()[0]
    width = len(StructType.fromDDL(sample.removeprefix("STRUCT<").removesuffix(">")))
    cells = F.from_csv("record", ", ".join(f"c{i} string" for i in range(width)), {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
    title = names.select(F.from_csv("h", ", ".join(f"c{i} string" for i in range(width)), {"quote": '"', "escape": '"'}).alias("c")).select("c.*").first()
    rows = quoted_records(spark, found).select(cells.alias("c")).select("c.*")
    return rows.toDF(*[t if t is not None else f"_c{i}" for i, t in enumerate(title)])


def read_csv_allowlist(spark: SparkSession, path, required, optional=(), multiline: bool = True, **options) -> DataFrame:
    """Text columns named in the allow-list; a missing required column is an error.

    Columns are matched by name in every file: files are grouped by their header line, each group is
    read with its own header, and the groups are united by name. Quoted newlines are kept, and large
    UTF-8 files are split all the same (``quoted_records``); files in another encoding, or read with
    options of Spark's reader, are one task each unless ``multiline`` is False.
    """
    out = None
    for header, found in sorted(headers(spark, path).items()):
        if multiline and not options:
            df = _read_quoted(spark, found, header)
        else:
            df = spark.read.options(header=True, multiLine=multiline, quote='"', escape='"', **options).csv(found)
        clean = {c.lstrip("\ufeff"): c for c in df.columns}
        absent = [c for c in required if c not in clean]
        if absent:
            raise ValueError(f"required columns absent: {absent}")
        part = df.select(*[F.col(f"`{clean[c]}`").alias(c) for c in [*required, *optional] if c in clean])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError(f"no lines in {path}")
    return out.select(*[c for c in [*required, *optional] if c in out.columns])


def detect_encodings(spark: SparkSession, path) -> DataFrame:
    """(file, encoding): first encoding that decodes every line of the file, found in one pass over the raw bytes."""

    def test(batches):
        for b in batches:
            bad: dict[str, list[int]] = {}
            for file, line in zip(b["file"].to_pylist(), b["line"].to_pylist(), strict=True):
                flags = bad.setdefault(file, [0] * len(ENCODINGS))
                for k, codec in enumerate(CODECS):
                    try:
                        line.decode(codec)
                    except UnicodeDecodeError:
                        flags[k] = 1
            yield pa.RecordBatch.from_arrays([pa.array(list(bad), pa.string()), *[pa.array([f[k] for f in bad.values()], pa.int32()) for k in range(len(ENCODINGS))]], ["file", *[f"bad_{k}" for k in range(len(ENCODINGS))]])

    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    schema = "file string, " + ", ".join(f"bad_{k} int" for k in range(len(ENCODINGS)))
    found = raw.mapInArrow(test, schema).groupBy("file").agg(*[F.max(f"bad_{k}").alias(f"bad_{k}") for k in range(len(ENCODINGS))])
    return found.select("file", F.coalesce(*[F.when(F.col(f"bad_{k}") == 0, e) for k, e in enumerate(ENCODINGS)]).alias("encoding"))


def read_csv_fallback(spark: SparkSession, path, required, optional=()) -> DataFrame:
    """Read each file in the first encoding that decodes it, then union the groups by name.

    Only the file list (already held by the driver's file index) reaches the driver.
    """
    groups: dict[str, list[str]] = {}
    for row in detect_encodings(spark, path).toLocalIterator():
        if row.encoding is None:
            raise ValueError(f"no encoding decodes {row.file}")
        groups.setdefault(row.encoding, []).append(row.file)
    if len(groups) > 1 or "utf-8" not in groups:
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # Spark 4 otherwise reads UTF and ASCII only; needed until the result is read
    parts = [read_csv_allowlist(spark, files, required, optional, encoding=enc).withColumn("encoding", F.lit(enc))
             for enc, files in sorted(groups.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_by_stem(spark: SparkSession, base: str, stem: str, required=(), optional=()) -> DataFrame:
    """All CSV files whose folder or file name contains the stem, by column name, with the source name.

    If there is none, all CSV files below ``base`` are read. Without an allow-list every file's
    columns are kept, missing ones null.
    """
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")  # names only: content is not read
    csv = [r.path for r in every.where(F.col("path").rlike(r"\.csv[^/]*")).toLocalIterator()]
    found = [p for p in csv if re.search(rf"[^/]*{re.escape(stem)}[^/]*\.csv", p[len(base.removeprefix("file:")):])] or csv
    name = F.regexp_extract(F.input_file_name(), rf"([^/]*{stem if found is not csv else ''}[^/]*\.csv[^/]*)", 1)
    out = None
    for header, paths in sorted(headers(spark, found).items()):
        df = spark.read.options(header=True, multiLine=True, quote='"', escape='"').csv(paths)
        clean = {c.lstrip("\ufeff"): c for c in df.columns}
        keep = [F.col(f"`{old}`").alias(c) for c, old in clean.items() if not required or c in [*required, *optional]]
        part = df.select(name.alias("source_name"), *keep)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def fingerprint_files(spark: SparkSession, path, block: int = 4 << 20) -> DataFrame:
    """SHA-256 of each file, streamed in blocks inside the tasks: constant memory, no size limit."""

    def digest(batches):
        for b in batches:
            out = []
            for uri in b["path"].to_pylist():
                fs, inner = pafs.FileSystem.from_uri(uri)
                h = hashlib.sha256()
                with fs.open_input_stream(inner) as stream:
                    while part := stream.read(block):
                        h.update(part)
                out.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([b["path"], b["length"], pa.array(out, pa.string())], ["path", "length", "sha256"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    return files.mapInArrow(digest, "path string, length bigint, sha256 string")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Written under a temporary name and renamed when the whole job has succeeded.

    An old table is moved aside for the rename and put back if it fails; it is deleted last.
    """
    spark = df.sparkSession
    temporary = f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.tmp"
    writer = df.write
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(temporary)
    source, target, aside = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (temporary, path, f"{temporary}.old"))
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    held = fs.exists(target)
    if held and not fs.rename(target, aside):
        raise OSError(f"could not move {path} aside")
    if not fs.rename(source, target):
        if held:
            fs.rename(aside, target)
        raise OSError(f"could not publish {path}")
    if held:
        fs.delete(aside, True)


def cached_table(spark: SparkSession, root: str, key: str, build) -> DataFrame:
    """Parquet kept under a content key; rebuilt only if no committed copy exists."""
    path = f"{root}/{key}"
    try:
        return spark.read.parquet(path)
    except Exception as e:  # an absent path is the only reason to build
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    write_table(build(), path)
    return spark.read.parquet(path)


def cache_key(sources: dict[str, DataFrame], **parameters) -> str:
    """Key from the sources' digests (one row each) and the parameters: it changes whenever either does."""
    from diurna.operators.contracts import frame_fingerprint

    parts = [f"{name}:{tuple(frame_fingerprint(df, df.columns).first())}" for name, df in sorted(sources.items())]
    return hashlib.sha256("|".join([*parts, repr(sorted(parameters.items()))]).encode()).hexdigest()[:24]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table used several times and read it back; survives executor loss."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)

"""Sources and sinks: binary files, partition trees, JSON lines, CSV tables, texts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.periods import period_from_filename, ticker_from_filename
from . import report_tree, stores
from .versioned import VersionedTable

MANIFEST = (
    "ticker string, period string, published string, report_type string, source_url string, pdf_path string, sha256 string, "
    "filename string, pages int, tables int, parser struct<engine:string,version:string>, "
    "structured struct<engine:string,model:string,path:string,confidence:double>, notes array<string>, _written_at string"
)

#: Bytes of files that a task reads, about.
_TASK = 1 << 26


def work_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, in the cluster's own place if it names one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quarterlens-")
        atexit.register(shutil.rmtree, named, True)
        named = f"file://{named}"
    return f"{named.rstrip('/')}/work-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df as a table in a new work folder, for what is read more than once. A lost executor costs a reread."""
    path = f"{work_folder(df.sparkSession)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tree_files(spark: SparkSession, path: str, prefix: str = "", inner: str = "") -> DataFrame:
    """Files at any depth under a folder whose place in it begins with prefix: name (place in the folder), size, updated, path. Contents
    aren't read. Of inner folders only those whose place has a match of inner are listed, where Arrow can open the store.

    Folders are listed in tasks, level by level, into tables: no list of the files stands in the driver. Folders that can't hold such
    files aren't listed. Spark's own reader, whose list of all files does, is left for stores that Arrow can't open, single files and
    patterns.
    """
    path = path.rstrip("/")
    if not stores.has_folder(path):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        name = F.element_at(F.split(F.col("path"), f"/{re.escape(path.rsplit('/', 1)[-1])}/"), -1)
        return found.select(name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("updated"), "path").filter(F.col("name").startswith(prefix))
    base = re.sub("^file:/*", "file:/", path if "://" in path or path.startswith("file:") else f"file:{path}")
    level, every = spark.createDataFrame([("",)], "folder string"), None
    while every is None or not level.isEmpty():
        dealt = level.repartition(spark.sparkContext.defaultParallelism)
        here = written(dealt.mapInArrow(stores.lister(path, prefix), stores.ENTRIES))
        level = here.filter(F.col("folder") & F.col("name").rlike(inner)).select(F.concat("name", F.lit("/")).alias("folder"))
        held = here.filter("NOT folder").select("name", "size", "updated", F.concat(F.lit(f"{base}/"), "name").alias("path"))
        every = held if every is None else every.unionByName(held)
    return every


def listing(spark: SparkSession, path: str, prefix: str = "", pattern: str = "*") -> DataFrame:
    """Files under a folder whose place in it begins with prefix, and whose own name is of the pattern: name (place in the folder),
    size, updated, extension. Contents aren't read."""
    name = F.col("name")
    named = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()
    return tree_files(spark, path, prefix).filter(F.element_at(F.split(name, "/"), -1).rlike(rf"(?s)\A(?:{named})\z")).select(
        "name", "size", "updated", F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1)).alias("extension")
    )


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf", recursive: bool = False) -> DataFrame:
    """Files with name, ticker, period, size and SHA-256. Columns that aren't asked for aren't computed: without the hash
    no content is read."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    name = F.element_at(F.split("path", "/"), -1)
    return reader.load(path).select(
        "path", name.alias("filename"), ticker_from_filename(name).alias("ticker"), period_from_filename(name).alias("period"),
        F.col("length").alias("file_size"), F.sha2("content", 256).alias("sha256"),
    )


def partition_tree(spark: SparkSession, path: str) -> DataFrame:
    """Files under {ticker}/{period}/...: ticker (upper case), period, file; folders that begin with a dot are left out."""
    full = F.concat(F.lit("/"), "name")
    inside = r"/([^/.][^/]*)/([^/.][^/]*)/(?:[^/]+/)*([^/]+)$"
    return tree_files(spark, path).select(
        F.upper(F.regexp_extract(full, inside, 1)).alias("ticker"), F.regexp_extract(full, inside, 2).alias("period"),
        F.regexp_extract(full, inside, 3).alias("filename"), "path", F.col("size").alias("length"),
    ).filter("ticker <> ''")


def output_sets(files: DataFrame) -> DataFrame:
    """PDFs with their text (required), tables and images, by the file's stem; lists are sorted by name."""
    stem = lambda suffix: F.regexp_extract("filename", rf"^(.*){suffix}$", 1)
    keys = ["ticker", "period", "stem"]
    pick = lambda suffix: files.filter(F.col("filename").rlike(rf"{suffix}$")).withColumn("stem", stem(suffix))
    listed = lambda df, n: df.groupBy(*keys).agg(F.array_sort(F.collect_list("filename")).alias(n))
    pdfs = pick(r"\.pdf").select(*keys, "filename")
    return (
        pdfs.join(pick(r"\.txt").select(*keys, F.col("filename").alias("text_file")), keys)
        .join(listed(pick(r"-t\d+\.csv"), "table_files"), keys, "left")
        .join(listed(pick(r"-p\d+-[^/]*\.png"), "image_files"), keys, "left")
    )


def json_lines(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """Entries of a JSON-lines file; malformed lines are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_lines_with_rejects(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """The same with malformed lines as rows that hold them in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def json_object(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object; an empty table where there is no such file."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """Ragged CSV tables in long form: file, row_no, col_no, value. Headers differ by file, so none is assumed; the line
    separator is given, as finding it by itself loses rows where quoted headers hold line breaks."""
    wide = (
        spark.read.option("header", "false").option("multiLine", "true").option("escape", '"').option("lineSep", "\n")
        .option("mode", "PERMISSIVE").csv(path)
    )
    cells = F.array(*[F.col(c) for c in wide.columns])
    numbered = wide.select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("_id"), cells.alias("cells"))
    rows = numbered.withColumn("row_no", F.row_number().over(Window.partitionBy("file").orderBy("_id")) - 1)
    return rows.select("file", "row_no", F.posexplode("cells").alias("col_no", "value")).filter(F.col("value").isNotNull())


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """The files right in a folder, or in folders key=value below it, each as one text: path, text; empty files give no row. As in
    tree_files, tasks list them, and read them; Spark's own reader, whose list of them stands in the driver, is left for the same cases."""
    if not stores.has_folder(path):
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    found = tree_files(spark, path, inner="=[^/]*$").filter("size > 0")
    total = found.agg(F.sum("size")).first()[0] or 0
    dealt = found.select("name", "path").repartition(max(spark.sparkContext.defaultParallelism, total // _TASK))
    read = dealt.mapInArrow(stores.reader(path), "path string, content binary")
    return read.select("path", F.col("content").cast("string").alias("text"))


def missing_objects(required: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return required.join(present.select(*keys).distinct(), keys, "left_anti")


def append_json_lines(df: DataFrame, path: str) -> None:
    """Appends entries; nothing that is there is read or rewritten."""
    df.write.mode("append").json(path)


def append_valid(df: DataFrame, errors: Column, path: str) -> DataFrame:
    """Appends the entries without errors, stamped with the time of writing, and returns the others."""
    checked = df.withColumn("_errors", errors)
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    append_json_lines(checked.filter(F.size("_errors") == 0).drop("_errors").withColumn("_written_at", stamp), path)
    return checked.filter(F.size("_errors") > 0)


def write_results(df: DataFrame, path: str) -> None:
    """A run's results with the time of writing; replaces what is there. Results are a row for each company."""
    df.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).coalesce(1).write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, keys: tuple[str, ...] = ("ticker", "period")) -> None:
    """One folder for each ticker and period, so that readers can prune."""
    df.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def write_layout(reports: DataFrame, root: str) -> None:
    """Reports (see report_tree.REPORTS) as one file each for text, table, image and metadata under {ticker}/{period}. Tasks write
    them aside and, once all are there, tasks move them."""
    job = uuid.uuid4().hex
    report_tree.put_aside(reports, root, job)
    report_tree.finish(reports.sparkSession, root, job)


def read_layout(spark: SparkSession, root: str) -> DataFrame:
    """The files of such folders, a row each (see report_tree.FILES); filters on ticker and period prune folders."""
    report_tree.register(spark)
    return spark.read.format("report_tree").option("path", root).load()


def read_folders(spark: SparkSession, root: str, tickers: list[str], periods: list[str]) -> DataFrame:
    """The same for some tickers (upper case) and periods, where what stands beside the driver must be little: no other folder is listed,
    and the format isn't needed."""
    return report_tree.in_folders(spark, root, tickers, periods)


def put_objects(objects: DataFrame, root: str, order: list[str] | None = None) -> DataFrame:
    """Stores objects (name, content, content_type, metadata: map) in a versioned table under root, and returns each one's address. Later
    puts of a name are further versions. A name that comes twice in one put keeps the row with the greatest `order` columns, by
    default the greatest content type and content."""
    VersionedTable(objects.sparkSession, f"{root}/objects", "name").put(objects, order or ["content_type", "content"])
    return objects.select("name", F.concat(F.lit(root.rstrip("/")), F.lit("/"), F.col("name")).alias("uri")).distinct()


def get_objects(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Each object as of a version, by default the last."""
    return VersionedTable(spark, f"{root}/objects", "name").read(version)


def put_by_key(rows: DataFrame, path: str, key: str, order: list[str] | None = None) -> int:
    """Puts one row for each key into a versioned table: rows of these keys are replaced, all others stay. Returns the version."""
    return VersionedTable(rows.sparkSession, path, key).put(rows, order)


def by_key(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return VersionedTable(spark, path).read(version)

"""Reading and writing: tables, checkpoints, snapshots, script metadata, marked output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.functions.regex import grab, java, strip

CHECKPOINT_SCHEMA = "id string, label string, url string, title string, element_count int, timestamp_s double, data_preview string, html string, _corrupt_record string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, a plain scan, dealt over all cores if it has fewer splits than there are: for small files and much work a row."""
    sc = df.sparkSession.sparkContext
    return df.repartition(sc.defaultParallelism) if df.rdd.getNumPartitions() < sc.defaultParallelism else df


def read_checkpoints(spark: SparkSession, folder: str) -> DataFrame:
    """Checkpoint files CP-n.json of a folder with their number; corrupt files are left out."""
    df = spark.read.schema(CHECKPOINT_SCHEMA).option("multiLine", "true").option("mode", "PERMISSIVE").json(f"{folder}/CP-*.json")
    df = df.withColumn("number", F.regexp_extract(F.col("_metadata.file_path"), r"CP-(\d+)\.json$", 1).try_cast("int"))
    return df.where("_corrupt_record is null and number is not null").drop("_corrupt_record").orderBy("number")


def write_snapshots(snapshots: DataFrame, folder: str) -> None:
    """Snapshots (turn, ...) as JSON, a folder for each turn."""
    snapshots.write.mode("overwrite").partitionBy("turn").json(folder)


def read_snapshots(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """Snapshots written as turn=n folders or as turn_n.json files, by turn."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(folder).orderBy("turn")


def content_hash(text: Column) -> Column:
    """Sixteen hex digits of a text's SHA-256."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def between_markers(text: Column, start: str, end: str) -> Column:
    """struct<value, rest>: what stands between two markers (null without both), and the text without it."""
    quoted = lambda m: r"\Q" + m + r"\E"
    value = grab(text, f"{quoted(start)}(.*?){quoted(end)}", 1, "s")
    rest = F.concat(F.substring_index(text, start, 1), F.regexp_replace(text, java(f"^.*?{quoted(start)}.*?{quoted(end)}", "s"), ""))
    return F.struct(strip(value).alias("value"), F.when(value.isNull(), text).otherwise(rest).alias("rest"))


SIGNALS = "struct<http_status:int,page_url:string,content:string,headers:map<string,string>,cookies:array<map<string,string>>>"


def page_signals(text: Column, start: str, end: str) -> Column:
    """The page signals that a run printed as JSON between markers; null if there are none or they are malformed."""
    value = between_markers(text, start, end)["value"]
    return F.when(value.startswith("{") & F.try_parse_json(value).isNotNull(), F.from_json(value, SIGNALS))


def escape_meta(text: Column) -> Column:
    """One line without triple quotes."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit('"""'), F.lit('\\"\\"\\"')), F.lit("\n"), F.lit("\\n"))


def unescape_meta(text: Column) -> Column:
    lines = F.replace(F.replace(text, F.lit("\\n"), F.lit("\n")), F.lit('\\"\\"\\"'), F.lit('"""'))
    return F.replace(lines, F.lit("\\\\"), F.lit("\\"))


def script_metadata(code: Column) -> Column:
    """map of the 'key: value' lines in a script's leading docstring; url and task are unescaped, first keys win."""
    doc = grab(code, r'^\s*"""(.*?)"""', 1, "s")
    lines = F.filter(F.transform(F.split(doc, "\n"), strip), lambda x: x.rlike(r"^[A-Za-z_]+:\s*\S"))
    pair = lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), strip(F.regexp_replace(x, "^[^:]*:", "")).alias("v"))
    pairs = F.transform(lines, pair)
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    first = lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.when(k.isin("url", "task"), unescape_meta(first(k))).otherwise(first(k))))


def input_types(text: Column) -> Column:
    """map of 'name (type), name (type)'; types other than str, int, float and bool are dropped."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Za-z_]\w*)\s*\((\w+)\)"), F.lit(0))
    pairs = F.filter(F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"^(\w+)", 1).alias("k"), F.regexp_extract(x, r"\((\w+)\)", 1).alias("v"))), lambda p: p["v"].isin("str", "int", "float", "bool"))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def save_scripts(scripts: DataFrame, path: str) -> None:
    """Scripts (url, task, code, ...) with the hash of their stripped code; what was there stays as <path>.bak."""
    spark = scripts.sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs
    here, bak = jvm.Path(path), jvm.Path(path + ".bak")
    fs = here.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(here):
        fs.delete(bak, True)
        fs.rename(here, bak)
    scripts.withColumn("content_hash", content_hash(strip(F.col("code")))).write.mode("overwrite").parquet(path)


def drift(scripts: DataFrame) -> DataFrame:
    """scripts with what no longer agrees with what is asked: domain, task, contract, or the code itself."""
    from harrow.functions import urls

    changed = [
        F.when(urls.host(F.col("url")) != urls.host(F.col("asked_url")), "domain"),
        F.when(strip(F.col("task")) != strip(F.col("asked_task")), "task"),
        F.when(~F.col("schema_hash").eqNullSafe(F.col("asked_schema_hash")), "schema"),
        F.when(F.col("content_hash") != content_hash(strip(F.col("code"))), "code"),
    ]
    return scripts.withColumn("drift", F.filter(F.array(*changed), lambda x: x.isNotNull()))

"""Page texts, file manifests, artifacts and section tables: reading, writing and keyed maintenance."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one source that are numbered together.
RUN = 4096
#: The name of a folder for no value, and in how many parts the rows of a source are dealt when stored.
DEFAULT, DEALT = "__HIVE_DEFAULT_PARTITION__", 64

SECTION_ITEM = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("section_id", "section_id_2", "section_start", "title", "summary")]
    + [T.StructField("search_keywords", T.ArrayType(T.StringType())), T.StructField("page", T.IntegerType()), T.StructField("header_bbox_pct", T.ArrayType(T.DoubleType()))]
)
VISUAL = T.StructType([T.StructField(n, T.StringType()) for n in ("type", "description", "relevance")])
MODEL_OUTPUT = T.StructType(
    [
        T.StructField("sections", T.ArrayType(SECTION_ITEM)),
        T.StructField("visuals", T.ArrayType(VISUAL)),
        T.StructField("visual_importance", T.IntegerType()),
        T.StructField("full_text", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("search_keywords", T.ArrayType(T.StringType())),
        T.StructField("boundary_header_on_next", T.StringType()),
    ]
)
ARTIFACT = T.StructType(
    [
        T.StructField("pdf", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("pdf_sha256", T.StringType()),
        T.StructField("page_pdf_sha256", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("llm", MODEL_OUTPUT),
        T.StructField("_bad", T.StringType()),
    ]
)


def clean_text(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " ", " ")


def numbered_pages(docs: DataFrame, source: str = "source", order: str = "doc_id", text: str = "text") -> DataFrame:
    """source, page, text and the order column: pages of a source numbered from 1 by `order`.

    Numbers are the counts of the runs before plus the place in the run, so a source with a third of all rows is
    numbered by as many tasks as it has runs of RUN.
    """
    rows = docs.select(F.col(source).alias("source"), F.col(order).alias(order), clean_text(F.col(text)).alias("text"), F.floor(F.col(order) / RUN).alias("_run"))
    sizes = rows.groupBy("source", "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("source").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select(F.col("source").alias("_s"), F.col("_run").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("source", "_run").orderBy(order))
    placed = rows.withColumn("_i", inside).join(base, F.col("source").eqNullSafe(F.col("_s")) & F.col("_run").eqNullSafe(F.col("_r")))
    return placed.select("source", (F.col("_base") + F.col("_i")).cast("int").alias("page"), "text", order)


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """source, page, text. From Parquet with those columns, or from text files, one page each, named <source>_pNNNN."""
    if kind == "parquet":
        return spark.read.parquet(path).select("source", F.col("page").cast("int").alias("page"), clean_text(F.col("text")).alias("text"))
    from ..functions.text import parse_page

    read = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), "[^/]*$", 0).alias("name"))
    return read.select(F.regexp_replace("name", r"(_p\d{4})?\.[^.]*$", "").alias("source"), parse_page(F.col("name")).alias("page"), clean_text(F.col("value")).alias("text"))


def write_page_files(docs: DataFrame, path: str, source: str = "source", order: str = "doc_id", text: str = "text", together: int = 256) -> None:
    """Texts as plain files source=<source>/part=<number>.txt, one for each source and `together` numbers, in order, each text with a line feed after it.

    A file is one row, so a source with a third of all rows has as many files as it needs. Null texts count as empty.
    Tasks write files themselves, wherever pyarrow's file systems reach: a folder a file, moved into place by the driver,
    costs more than the text. A file has the same name and content however often its task runs.
    """
    rows = docs.select(F.col(source).cast("string").alias("source"), F.floor(F.col(order) / together).alias("part"), F.struct(F.col(order).alias("o"), F.coalesce(F.col(text), F.lit("")).alias("t")).alias("row"))
    files = rows.groupBy("source", "part").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda r: r["t"]), "\n"), F.lit("\n")).cast("binary").alias("value"))

    def put(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        made = set()
        for batch in batches:
            for name, part, value in zip(*(batch.column(c) for c in ("source", "part", "value"))):
                folder = f"{root}/source={folder_name(name.as_py())}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                number = DEFAULT if part.as_py() is None else part.as_py()
                with store.open_output_stream(f"{folder}/part={number}.txt", compression=None) as out:
                    out.write(value.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["files"])

    files.mapInArrow(put, "files long").agg(F.sum("files")).collect()


def folder_name(value: str | None) -> str:
    """A value in the name of a folder, as Spark writes it."""
    return re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value) if value else DEFAULT


def file_manifest(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """name, size_bytes, modified, path of files; their bytes are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(folder)
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"), "path")


def content_hashes(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """name, sha256, path of files, by their bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(folder)
    return files.select(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.sha2("content", 256).alias("sha256"), "path")


def read_artifacts(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Page artifacts, and the files that can't be read as one (path, _bad). lines: files hold an artifact a line."""
    read = spark.read.schema(ARTIFACT).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    read = read.withColumn("path", F.input_file_name())
    bad = F.col("_bad").isNotNull() | F.col("llm").isNull()
    return read.where(~bad).drop("_bad", "path"), read.where(bad).select("path", "_bad")


def write_sections(sections: DataFrame, path: str) -> None:
    """Replace the rows of the sources that `sections` holds; other sources stay.

    Rows of a source are dealt by their id, so that a large one is not one task's; Spark joins small parts and splits
    large ones by their size.
    """
    dealt = sections.withColumn("_dealt", F.pmod(F.xxhash64("id"), F.lit(DEALT)))
    spread = dealt.hint("rebalance", F.col("source"), F.col("_dealt")).drop("_dealt").sortWithinPartitions("source", "id")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def read_sections(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Rows with an id and a text."""
    return spark.read.format(kind).load(path).where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("text", F.lit("")) != ""))


def insert_chunks(target: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """target and the rows of new whose key it lacks; of new rows with one key the first by content stays."""
    first = new.dropDuplicates([key])
    return target.unionByName(first.join(target.select(key), key, "left_anti").select(*target.columns))


def upsert_chunks(target: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """new rows, and the rows of target whose key they lack."""
    return target.join(new.select(key), key, "left_anti").select(*target.columns).unionByName(new.dropDuplicates([key]).select(*target.columns))


def delete_source(target: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """What is left, and a row with the number of rows removed."""
    hit = F.col("source").eqNullSafe(F.lit(source))
    return target.where(~hit), target.where(hit).agg(F.count("*").alias("removed"))


def flatten_metadata(df: DataFrame) -> DataFrame:
    """Scalars as they are, everything else as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema.fields])


def lookup(chunks: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """The chunks whose key is among keys; the optimizer broadcasts keys if they are few."""
    return chunks.join(keys.select(*on).distinct(), on, "left_semi")


def list_chunks(chunks: DataFrame, contains: str = "", preview: int = 160, limit: int | None = None) -> DataFrame:
    found = chunks.where(F.lower("id").contains(contains.lower())).select("id", F.substring("text", 1, preview).alias("preview"))
    return found.orderBy("id").limit(limit) if limit else found


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"

"""Dataset sources (S1-S9, O1): JSONL with bad-line quarantine, Parquet,
recursive directory scans, image-QA metadata, blended multi-format sources,
split selection, per-source heads.

Every reader is a Spark reader; files are listed and split by Spark. Scratch
files written by the queries go under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

ROLE_CONTENT = T.ArrayType(T.StructType([T.StructField("role", T.StringType()),
                                         T.StructField("content", T.StringType())]))
SFT_SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("messages", ROLE_CONTENT),
                           T.StructField("message", ROLE_CONTENT)])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """JSONL with an explicit schema. Blank lines are skipped by the
    reader; a malformed line lands in ``_corrupt_record`` instead of failing
    the job. Returns (good rows, rejected lines with their file)."""
    good, bad = _split_json(spark.read.schema(_with_corrupt(schema)).json(path), schema)
    return good.drop("_file"), bad


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name != CORRUPT] + [T.StructField(CORRUPT, T.StringType())])


def _split_json(raw: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows and malformed lines of a scan with :func:`_with_corrupt`, both with
    their ``_file``."""
    raw = raw.withColumn("_file", F.col("_metadata.file_path"))
    # Spark refuses scans of raw JSON that need only the corrupt-record
    # column (e.g. a count of bad lines), so the reject predicate also reads a
    # parsed column; it cannot be folded away.
    first = schema.fields[0].name
    is_bad = F.col(CORRUPT).isNotNull() & F.coalesce(F.col(CORRUPT), F.col(first).cast("string")).isNotNull()
    good = raw.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = raw.filter(is_bad).select("_file", CORRUPT, first)
    return good, bad


def _any_case(ext: str) -> str:
    """Glob of a file extension in any mix of cases."""
    return "*." + "".join(f"[{c}{c.upper()}]" for c in ext)


def _places(df: DataFrame) -> DataFrame:
    """``__f, __b, __m``: file, split and place within the task of each row of a file
    scan; in this order the rows of a file are in file order, however it is split."""
    return df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"),
                     F.monotonically_increasing_id().alias("__m"))


def _tree(spark: SparkSession, ext: str):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", _any_case(ext)).option("ignoreCorruptFiles", "true")


def _parquet_tree(spark: SparkSession, root: str) -> DataFrame:
    """All readable Parquet files; the schema is that of all footers, so a damaged file
    does not decide it."""
    return _tree(spark, "parquet").option("mergeSchema", "true").parquet(root)


def _json_lines(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """Numbered, parsed lines of a text scan: ``_file, _row`` (line number from 0, blank
    lines counted), the fields, and ``_corrupt_record`` where a line is malformed."""
    from posttrain.operators.index import keyed_row_number
    rows = keyed_row_number(_places(lines), ["__f"], "__b", tiebreak=["__m"], out="_row")
    full = _with_corrupt(schema)
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    d = rows.where(F.col("value").rlike(r"[^\x20\x09-\x0D]")).select(F.col("__f").alias("_file"), "_row", parsed.alias("__j"))
    return d.select("_file", "_row", *(F.col("__j")[f.name].alias(f.name) for f in full.fields))


def scan_dir_rejects(spark: SparkSession, root: str, jsonl_schema: T.StructType) -> DataFrame:
    """``_file, _row, _corrupt_record, reason`` of what :func:`scan_dir` leaves out: the
    malformed lines of JSONL files with their line numbers, and Parquet files that give
    no row (damaged ones, and whole files that are empty)."""
    out = None
    try:
        lines = _json_lines(_tree(spark, "jsonl").text(root), jsonl_schema)
        out = lines.where(F.col(CORRUPT).isNotNull()).select("_file", "_row", CORRUPT, F.lit("malformed line").alias("reason"))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    files = _tree(spark, "parquet").format("binaryFile").load(root).select(F.col("_metadata.file_path").alias("_file"), "length")
    try:
        read = _parquet_tree(spark, root).select(F.col("_metadata.file_path").alias("_file")).distinct()
        files = files.join(read, "_file", "left_anti")
    except AnalysisException as e:  # no file has a schema
        if "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    bad = files.select("_file", F.lit(None).cast("long").alias("_row"), F.lit(None).cast("string").alias(CORRUPT), F.lit("no readable rows").alias("reason"))
    return bad if out is None else out.unionByName(bad)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S2."""
    return spark.read.parquet(path)


def scan_dir(spark: SparkSession, root: str, jsonl_schema: T.StructType | None = None) -> DataFrame:
    """S3: recursive scan of ``.jsonl`` and ``.parquet`` files (any case), one read per
    format, columns unioned by name. Rows carry ``_file`` and ``_row``, their line or row
    in it from 0 (O1); line numbers are bucketed positions, so a large file is numbered by
    many tasks. What cannot be read is left out here and listed by
    :func:`scan_dir_rejects`."""
    frames = []
    for ext in ("parquet", "jsonl"):
        try:
            if ext == "jsonl":
                schema = jsonl_schema if jsonl_schema is not None else _tree(spark, ext).json(root).schema
                lines = _json_lines(_tree(spark, ext).text(root), schema)
                df = lines.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
            else:
                df = _parquet_tree(spark, root).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
        except Exception as e:  # no file of this format under root
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e) or "empty" in str(e).lower():
                continue
            raise
        frames.append(df)
    if not frames:
        raise ValueError(f"no .jsonl/.parquet files under {root}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def source_guard(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Fail early on a missing path or a source with no rows."""
    try:
        df = spark.read.format(fmt).load(path)
    except Exception as e:
        raise ValueError(f"data source not found or unreadable: {path}") from e
    if df.isEmpty():
        raise ValueError(f"data source has no rows: {path}")
    return df


def image_qa_scan(spark: SparkSession, root: str) -> DataFrame:
    """``metadata.jsonl`` rows (``messages: [{question, answer}]``,
    ``file_name``) -> image path joined to the root, question and answer lists."""
    qa = T.ArrayType(T.StructType([T.StructField("question", T.StringType()),
                                   T.StructField("answer", T.StringType())]))
    schema = T.StructType([T.StructField("messages", qa), T.StructField("file_name", T.StringType())])
    m = spark.read.schema(schema).json(os.path.join(root, "metadata.jsonl"))
    return m.select(F.concat_ws("/", F.lit(root.rstrip("/")), F.col("file_name")).alias("image_path"),
                    F.transform("messages", lambda x: x["question"]).alias("questions"),
                    F.transform("messages", lambda x: x["answer"]).alias("answers"))


def read_arrow_ipc(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Arrow IPC files (``.arrow``): Spark lists and ships the files
    (``binaryFile``), pyarrow decodes them inside tasks (``mapInPandas``)."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def decode(batches):
        import io

        import pyarrow as pa
        import pyarrow.ipc as ipc
        for pdf in batches:
            for blob in pdf["content"]:
                buf = pa.py_buffer(blob)
                try:
                    table = ipc.open_file(buf).read_all()
                except pa.ArrowInvalid:
                    table = ipc.open_stream(io.BytesIO(blob)).read_all()
                yield table.to_pandas()

    return files.mapInPandas(decode, schema)


def load_source(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S7 item: pick the reader from the extension (json/jsonl, csv, parquet,
    arrow) or read a saved dataset directory as Parquet."""
    p = path.lower().rstrip("/")
    if p.endswith((".json", ".jsonl")):
        r = spark.read.schema(schema) if schema else spark.read
        return r.json(path)
    if p.endswith(".csv"):
        r = spark.read.option("header", "true")
        return r.schema(schema).csv(path) if schema else r.option("inferSchema", "true").csv(path)
    if p.endswith(".arrow"):
        if schema is None:
            raise ValueError("arrow sources need a schema")
        return read_arrow_ipc(spark, path, schema)
    return spark.read.parquet(path)


def placed_source(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A source with ``__f, __b, __m``, an order of its rows that follows the files. All
    columns of a JSON or CSV row are parsed whatever a plan needs, so every pass over
    the files sees the same rows."""
    kind = path.lower().rstrip("/").rpartition(".")[2]
    if kind in ("json", "jsonl"):
        kinds = T._parse_datatype_string(schema) if schema else spark.read.json(path).schema
        lines = _places(spark.read.text(path)).where(F.col("value").rlike(r"[^\x20\x09-\x0D]"))
        return lines.select(F.from_json("value", kinds).alias("__j"), "__f", "__b", "__m").select("__j.*", "__f", "__b", "__m")
    if kind == "csv":
        r = spark.read.option("header", "true").option("columnPruning", "false")
        return _places(r.schema(schema).csv(path) if schema else r.option("inferSchema", "true").csv(path))
    if kind == "arrow":
        df = load_source(spark, path, schema)
        return df.select("*", F.lit("").alias("__f"), F.lit(0).cast("long").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    return _places(spark.read.parquet(path))


def blend_sources(spark: SparkSession, spec: str, schema: str | None = None, split: str | None = None, max_count: int | None = None,
                  overall: int | None = None, probabilities: Sequence[float] | None = None, seed: int = 42) -> DataFrame:
    """S7 with S8, S9, U1 and U2: a comma list of ``path`` or ``path@data_dir`` items, each
    read by its format. Of each source the rows of ``split`` are taken (all, where it has
    no ``split`` column), then its first ``max_count`` rows in file order. Sources are
    put one after the other, or, with ``probabilities`` (one for each), drawn from with
    recycling; ``overall`` cuts the head of the result.

    Rows carry ``source_idx`` and ``row_idx``, their place in what was taken of the
    source, and ``draw`` when drawn. Hub and script loaders are not supported (network,
    arbitrary code)."""
    from posttrain.operators import blend
    from posttrain.session import materialize
    items = [x.strip() for x in spec.split(",") if x.strip()]
    if probabilities is not None and len(probabilities) != len(items):
        raise ValueError("one probability for each source is needed")
    frames = []
    for item in items:
        path, _, sub = item.partition("@")
        df = placed_source(spark, os.path.join(path.strip(), sub.strip()) if sub else path, schema)
        frames.append(split_select(df, split) if split else df)
    places = ["__f", "__b", "__m"]
    out = blend.concat_datasets(frames, places[0], tiebreak=places[1:], max_count=max_count,
                                overall=overall if probabilities is None else None).drop(*places)
    if probabilities is None:
        return out
    # the draws read the sources several times: from a written table, not from the files
    drawn = blend.interleave(spark, materialize(out, "blend"), probabilities, seed=seed, order_col="row_idx")
    return drawn if overall is None else drawn.where(F.col("draw") < overall)


def split_select(df: DataFrame, split: str, split_col: str = "split") -> DataFrame:
    """Rows of the named split when the data has splits, else everything."""
    return df.filter(F.col(split_col) == split) if split_col in df.columns else df


def max_count_head(df: DataFrame, max_count: int, order_col: str, source_col: str | None = None) -> DataFrame:
    """First min(max_count, n) rows per source (rows without a source are one),
    or overall. Both forms cut every task's rows to the head before the shuffle."""
    if source_col is None:
        return df.orderBy(order_col).limit(max_count)
    w = Window.partitionBy(source_col).orderBy(order_col)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= max_count).drop("__rn")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint dir for files a query derives; two
    calls never share one."""
    from posttrain.session import checkpoint_dir
    return os.path.join(checkpoint_dir(spark), "posttrain-src", f"{name}-{uuid.uuid4().hex}")

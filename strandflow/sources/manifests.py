"""Delimited manifests, catalogue files and JSON catalogues with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.functions import names
from strandflow.sources.lines import numbered_lines

GENOME_COLUMNS = ("accession", "taxonomy", "taxid", "fasta", "gff")
def column_of_lines(spark: SparkSession, path: str, column: int = 0, separator: str = ",") -> DataFrame:
    """(line_no, value): one field of every line that isn't blank; a line without it raises."""
    lines = numbered_lines(spark, path).where(F.length(names.trim_ascii(F.col("value"))) > 0)
    part = F.get(F.split(F.col("value"), "\\Q" + separator + "\\E", -1), F.lit(column))
    missing = F.when(part.isNull(), F.raise_error(F.lit("manifest: line without that column")).cast("string"))
    return lines.select("line_no", names.trim_ascii(F.coalesce(part, missing)).alias("value"))


def file_paths(spark: SparkSession, path: str, column: int = 0, separator: str = ",", kind: str | None = None) -> DataFrame:
    """(line_no, value, file_type): paths of a manifest, of one type if asked; an unknown type raises."""
    rows = column_of_lines(spark, path, column, separator).withColumn("file_type", names.file_type(F.col("value")))
    unknown = F.when(F.col("file_type").isNull(), F.raise_error(F.concat(F.lit("manifest: unknown type: "), "value")).cast("string"))
    checked = rows.withColumn("_e", unknown).where("_e is null").drop("_e")
    return checked.where(F.col("file_type") == kind) if kind else checked


def genome_manifest(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """Genome manifest by column mapping (ours -> theirs); empty text is null; the last row of an accession counts."""
    mapping = {c: c for c in GENOME_COLUMNS} | (columns or {})
    raw = spark.read.option("header", "true").csv(path)
    lacking = [c for c in ("accession", "taxonomy") if mapping[c] not in raw.columns]
    if lacking:
        raise ValueError(f"manifest: no column for {', '.join(lacking)}")
    cells = [F.nullif(F.trim(F.col(f"`{mapping[c]}`")), F.lit("")).alias(c) if mapping[c] in raw.columns else F.lit(None).cast("string").alias(c) for c in GENOME_COLUMNS]
    rows = raw.select(*cells, F.monotonically_increasing_id().alias("_n"))
    return last_rows(rows, ["accession"], F.col("_n")).drop("_n")


def last_rows(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """One row per key: the last in ``order``; null keys left out."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return df.where(" and ".join(f"`{k}` is not null" for k in keys)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with ``#`` lines of metadata before its header."""
    return spark.read.option("header", "true").option("comment", "#").csv(path)


def catalogue_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text): the ``#`` lines before the header, without the sign."""
    lines = numbered_lines(spark, path)
    header = lines.where(~F.col("value").startswith("#")).agg(F.min("line_no")).first()[0]  # one number
    before = lines.where(F.col("value").startswith("#") & (F.lit(True) if header is None else F.col("line_no") < header))
    return before.select("line_no", F.ltrim(F.expr("substring(value, 2)")).alias("text"))


def require_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """``paths``, the work list of a build; those that don't exist raise."""
    lacking = []
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            lacking.append(path)
    if lacking:
        raise FileNotFoundError(f"manifest: {len(lacking)} files are missing, such as {', '.join(lacking[:5])}")
    return paths


def sample_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("sample string, forward string, reverse string").option("header", "true").csv(path)


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """CSV or TSV by its suffix."""
    plain = path.removesuffix(".gz").lower()
    sep = "\t" if plain.endswith(".tsv") else "," if plain.endswith(".csv") else None
    if sep is None:
        raise ValueError(f"manifest: neither csv nor tsv: {path}")
    return spark.read.option("header", "true").option("sep", sep).csv(path)


def file_list(rows: DataFrame, name: str = "filename") -> tuple[DataFrame, DataFrame]:
    """(batch archives, file lists) of a listing."""
    return rows.where(F.col(name).contains(".batch.")), rows.where(F.col(name).contains("File_Lists/"))


def _checked(condition: Column, message: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.raise_error(F.lit("catalogue: " + message)).cast("string"))


def parse_datasets(texts: DataFrame, text: str = "value") -> DataFrame:
    """Entries of JSON catalogues (a list, or an object with the list under ``datasets``), one row each, as
    (id, name, domain, data_type, organism, assay, files ARRAY<STRUCT>, metadata STRUCT<tags, attributes>).

    Top-level keys that the schema doesn't name go into ``metadata.attributes``, over attributes of the same name. Raises for an
    entry without id, name, domain or data_type, a negative file size, and a checksum without algorithm or value.
    """
    entry = "array<map<string,string>>"
    listed = F.coalesce(F.from_json(F.get_json_object(text, "$.datasets"), entry), F.from_json(text, entry))
    rows = texts.select(F.explode(listed).alias("m"))
    known = ("id", "name", "domain", "data_type", "organism", "assay")
    cells = [F.nullif(F.col("m")[c], F.lit("")).alias(c) for c in known]
    raw_files = F.from_json(F.col("m")["files"], "array<struct<role:string,url:string,filename:string,size_bytes:bigint,checksum:string>>")
    sums = F.transform(raw_files, lambda f: F.from_json(f["checksum"], "struct<algorithm:string,value:string>"))
    as_text = lambda f, c: F.when(f["checksum"].isNotNull(), F.coalesce(F.concat_ws(":", c["algorithm"], c["value"]), f["checksum"]))
    files = F.zip_with(raw_files, sums, lambda f, c: F.struct(f["role"].alias("role"), f["url"].alias("url"), f["filename"].alias("filename"), f["size_bytes"].alias("size_bytes"), as_text(f, c).alias("checksum")))
    extra = F.map_filter("m", lambda k, _: ~k.isin(*known, "files", "metadata"))
    given = F.from_json(F.col("m")["metadata"], "struct<tags:array<string>,attributes:map<string,string>>")
    own = F.map_filter(F.coalesce(given["attributes"], F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(extra, k))
    meta = F.struct(given["tags"].alias("tags"), F.map_concat(own, extra).alias("attributes"))
    out = rows.select(*cells, files.alias("files"), meta.alias("metadata"), sums.alias("_s"), raw_files.alias("_f"))
    bad_sum = F.exists(F.arrays_zip("_f", "_s"), lambda z: z["_f"]["checksum"].startswith("{") & (F.coalesce(z["_s"]["algorithm"], F.lit("")).isin("") | F.coalesce(z["_s"]["value"], F.lit("")).isin("")))
    error = F.coalesce(
        _checked(F.greatest(*[F.col(c).isNull() for c in ("id", "name", "domain", "data_type")]), "required field missing"),
        _checked(F.exists("_f", lambda f: f["size_bytes"] < 0), "negative file size"),
        _checked(bad_sum, "checksum without algorithm or value"),
    )
    return out.withColumn("_e", error).where("_e is null").drop("_e", "_s", "_f")


def datasets(spark: SparkSession, path: str) -> DataFrame:
    """Dataset catalogue from JSON files; see :func:`parse_datasets`."""
    return parse_datasets(spark.read.text(path, wholetext=True))


def filter_datasets(rows: DataFrame, tags: list[str] | None = None, **equal: str | None) -> DataFrame:
    """Entries with the given field values and all of ``tags``."""
    for field, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(field) == value)
    if tags:
        rows = rows.where(F.size(F.array_except(F.array(*map(F.lit, tags)), F.coalesce("metadata.tags", F.array().cast("array<string>")))) == 0)
    return rows


def report_features(reports: DataFrame, types: dict, links: dict) -> DataFrame:
    """(report_id, sequence_no, n_features): features of annotation reports grouped by the sequence they name."""
    from strandflow.operators.nested import label_nodes

    nodes = label_nodes(reports, "report_id", "payload", types, links, keep_untyped=False)
    return nodes.where("node_type = 'features'").groupBy(F.col("record_id").alias("report_id"), F.col("linked_position").alias("sequence_no")).agg(F.count("*").alias("n_features"))

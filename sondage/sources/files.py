"""Sources: manifests, event logs, annotations, feature bundles, file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import boxes
from ..functions.fields import stem_prefix

#: Folder of a sample -> where its data come from.
GROUPS = {"bid_fraude": "bid", "bid_legitimos": "bid", "reais_fraude": "reais", "reais_legitimos": "reais"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def source_of(path: Column) -> Column:
    """Data source of a file, by the group folder in its path; null outside the groups."""
    group = F.regexp_extract(path, f"/({'|'.join(GROUPS)})/", 1)
    return F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])[group]


def manifests(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """Manifests below `root`, one JSON object for each file, with caminho and fonte_dados.

    Unknown keys vanish; files that are no JSON objects or have no id are left out. The listing of
    one folder comes in the order of the paths.
    """
    reader = spark.read.schema(schemas.MANIFEST).option("multiLine", True).option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.manifesto.json")
    rows = reader.json(root).withColumn("caminho", F.col("_metadata.file_path"))
    found = rows.where("id is not null and id <> ''").withColumn("fonte_dados", source_of(F.col("caminho")))
    return found if recursive else found.orderBy("caminho")


def events(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of event logs; lines that are no JSON objects are left out."""
    return spark.read.schema(schemas.EVENT).option("mode", "DROPMALFORMED").json(path)


def _windows() -> tuple[str, str]:
    """Characters of Latin-1 that Windows-1252 has other characters for, and those."""
    pairs = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    return "".join(a for a, c in pairs if c), "".join(c for _, c in pairs)


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-8 without a mark at its start, else Windows-1252, else (where that has no
    character for a byte) Latin-1, which has one for every byte."""
    utf8 = F.try_validate_utf8(content.cast("string"))
    gap = F.hex(content).rlike("^(?:..)*(?:81|8D|8F|90|9D)")
    latin = F.decode(content, "ISO-8859-1")
    return F.when(utf8.isNotNull(), F.regexp_replace(utf8, "^\ufeff", "")).when(gap, latin).otherwise(F.translate(latin, *_windows()))


def boxes_of(spark: SparkSession, path: str) -> DataFrame:
    """caminho, place and x, y, w, h, texto of the annotation lines of text files."""
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True).load(path)
    lines = whole.select(F.col("path").alias("caminho"), F.posexplode(F.split(decoded(F.col("content")), r"\r\n|\n|\r")).alias("place", "line"))
    return lines.select("caminho", "place", boxes.parse(F.col("line")).alias("b")).where("b is not null").select("caminho", "place", "b.*")


def features(spark: SparkSession, path: str) -> DataFrame:
    """Feature rows with an explicit key in place of aligned arrays."""
    return spark.read.schema(schemas.FEATURE).parquet(path)


def sample_index(spark: SparkSession, root: str) -> DataFrame:
    """caminho, rotulo (1 or 0), tecnica, documento_origem, tipo_documento, gerador and fonte of each PNG
    image below the folders of known sources, from the manifest beside it. Without a manifest the label and the technique
    come from the folders."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(root).select(F.col("path").alias("caminho")).withColumn("_stem", F.regexp_replace("caminho", r"\.png$", ""))
    beside = manifests(spark, root).select(F.regexp_replace("caminho", r"\.manifesto\.json$", "").alias("_stem"), *[F.col(c).alias(f"_{c}") for c in ("rotulo", "tecnica", "documento_origem", "tipo_documento", "gerador")])
    # one scan names paths with a scheme of one slash, the other of three
    same = lambda c: F.regexp_replace(c, "^file:/+", "/")
    joined = found.withColumn("_stem", same("_stem")).join(beside.withColumn("_stem", same("_stem")), "_stem", "left").withColumn("fonte", source_of(F.col("caminho"))).where("fonte is not null")
    label = F.coalesce("_rotulo", F.when(F.col("caminho").rlike("_fraude/"), "fraude").otherwise("legitimo"))
    folder = F.regexp_extract("caminho", r"([^/]*)/[^/]*$", 1)
    text = lambda c: F.coalesce(c, F.lit("")).alias(c[1:])
    return joined.select("caminho", (label == "fraude").cast("int").alias("rotulo"), F.coalesce("_tecnica", folder).alias("tecnica"), text("_documento_origem"), text("_tipo_documento"), text("_gerador"), "fonte").orderBy("caminho")


def images(spark: SparkSession, root: str, label: int = 1) -> DataFrame:
    """caminho, y, tecnica (the folder of positives; legitimo for negatives) and documento (name up to its first
    two underscores) of image files, without their contents. `label` is that of all of them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("caminho"))
    return found.where(F.lower("caminho").rlike(r"\.(png|jpe?g)$")).select("caminho", F.lit(label).alias("y"), (F.regexp_extract("caminho", r"([^/]*)/[^/]*$", 1) if label else F.lit("legitimo")).alias("tecnica"), stem_prefix(F.col("caminho")).alias("documento"))

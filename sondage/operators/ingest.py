"""Ingestion: manifests as sample rows, and their upsert into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import privacy
from ..sources import files, sinks
from . import merge


def sample_rows(manifests: DataFrame) -> DataFrame:
    """The sample columns of manifests (schemas.MANIFEST and fonte_dados).

    A missing label counts as fraud, missing parameters are an empty object. Samples of real
    documents lose sensitive parameters, have path-like strings at any depth of the others as
    pseudonyms, and a file name without the name of their document. No column holds the
    document's own name.
    """
    real = F.col("fonte_dados").eqNullSafe("reais")
    empty = F.parse_json(F.lit("{}"))
    clean = F.when(real, privacy.sanitize_parameters(F.col("parametros"))).otherwise(F.col("parametros"))
    document = privacy.document_id(F.coalesce("documento_origem", F.lit("")))
    name = F.coalesce("arquivo_gerado", F.lit(""))
    values = {
        "rotulo": F.coalesce("rotulo", F.lit("fraude")),
        "fonte_tipografica": F.col("fonte"),
        "documento_id": document,
        "arquivo": F.when(real, privacy.sanitize_file_name(name, document)).otherwise(name),
        "parametros": F.coalesce(clean, empty),
        "parametros_captura": F.coalesce("parametros_captura", empty),
    }
    return manifests.select(*[values.get(c, F.col(c)).alias(c) for c in schemas.SAMPLE])


def ingest_manifests(manifests: DataFrame, table: str, parts: int | None = None, keep: int = 1) -> DataFrame:
    """Upsert the samples of manifests into a table of samples by id.

    Of manifests with one id the last by timestamp and then by its whole row wins. Returns one
    row: keys inserted, modified and left as they were. With `parts` a new table is one for merges that change most
    of it (sinks.merge_bucketed). The last `keep` versions before this one stay.
    """
    parts = sinks.bucketed_versions(manifests.sparkSession, table)[0] or parts
    rows = latest_samples(manifests)
    return sinks.merge_bucketed(rows, table, ["id"], parts, keep) if parts else sinks.merge_table(rows, table, ["id"], keep=keep)


def latest_samples(manifests: DataFrame) -> DataFrame:
    rows = sample_rows(manifests).withColumns({"_text": F.to_json(F.struct(*schemas.SAMPLE)), "_ts": F.coalesce("timestamp", F.lit(""))})
    return merge.latest(rows, ["id"], ["_ts", "_text"], schemas.SAMPLE)


def ingest_samples(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Scan the manifests below `root` in the folders of known sources and upsert them."""
    return ingest_manifests(files.manifests(spark, root).where("fonte_dados is not null"), table)


def ingest_events(events: DataFrame, epochs: str, evaluations: str) -> tuple[DataFrame, DataFrame]:
    """Upsert epochs by (run_id, epoca) and generator states by (run_id, ts) into their tables,
    field by field: what an event lacks stays as it was. Other events are left out."""
    out = []
    for rows, table, keys in zip(merge.route(events, F.col("tipo")), (epochs, evaluations), (["run_id", "epoca"], ["run_id", "ts"]), strict=True):
        fields = [c for c in rows.columns if c not in keys]
        place = rows.withColumn("_place", F.to_json(F.struct(*rows.columns)))
        order = ["_place"] if "ts" in keys else ["ts", "_place"]
        out.append(sinks.merge_table(merge.field_merge(place, keys, order, fields).select(*rows.columns), table, keys, by_field=True))
    return out[0], out[1]

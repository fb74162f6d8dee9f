"""How scores are shown and read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of the bands and the least number of rows for a verdict.
BANDS = (0.55, 0.70, 0.90)
LEAST_ROWS = 20
DASH = "—"
#: Shown names of internal keys.
NAMES = {
    "edicao_campos": "Edição de campos de texto",
    "troca_foto": "Troca da foto de rosto",
    "render_classico": "Texto reescrito com fonte do sistema",
    "transplante_glifo": "Texto montado com glifos do documento",
    "landmark_classico": "Rosto alinhado por landmarks",
    "inswapper": "Rosto trocado por rede neural",
    "rabisco": "Assinatura sintética",
    "bid": "BID · dados sintéticos",
    "reais": "Documentos reais",
}
#: Colours of a chart's series in order.
COLOURS = ["#4c8dff", "#2ea56b", "#a78bfa", "#c8922a", "#d9544d", "#22b8cf"]


def missing(v: Column) -> Column:
    return v.isNull() | F.isnan(v)


def format_auc(v: Column) -> Column:
    """Three decimals with a comma, as the double itself rounds (its shortest digits do not: 0.5005 is below the half);
    an exact half goes to the even digit. A dash for null and NaN."""
    # 0.0005 lies above the half, but format_number() takes it for one
    near = F.when(F.abs(v) == 0.0005, F.signum(v) * 0.001).otherwise(v)
    text = F.translate(F.format_number(near, 3), ".,", ",")  # the point becomes a comma, separators of thousands go
    return F.when(missing(v), DASH).when(F.abs(v) == float("inf"), v.cast("string")).otherwise(text)


def band(v: Column) -> Column:
    """Struct of tone and text of a score's band."""
    of = lambda tone, text: F.struct(F.lit(tone).alias("variante"), F.lit(text).alias("rotulo"))
    return F.when(missing(v), of("info", DASH)).when(v < BANDS[0], of("ok", "não distingue")).when(v < BANDS[1], of("info", "sinal fraco")).when(v < BANDS[2], of("warn", "sinal forte")).otherwise(of("bad", "suspeito"))


def verdict(auc: Column, separability: Column) -> Column:
    """bom, meio or ruim: whether the model tells frauds apart, if not by their source."""
    good = (auc >= 0.7) & (separability.isNull() | (separability < 0.9))
    return F.when(good, "bom").when(auc >= 0.6, "meio").otherwise("ruim")


def technique_text(key: Column, v: Column) -> Column:
    """Class of the text for one technique: esperado, sem sinal, sinal fraco, consistente or atalho."""
    return F.when(v < BANDS[0], F.when(key == "edicao_campos", "esperado").otherwise("sem sinal")).when(v < BANDS[1], "sinal fraco").when(v < BANDS[2], "consistente").otherwise("atalho")


def gauge_position(v: Column) -> Column:
    """Percent of the way from 0.5 to 1, kept between 0 and 100; null and NaN stand at the start."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.when(missing(v), 0.5).otherwise(v) - 0.5) / 0.5)) * 100


def shown_name(key: Column, names: dict[str, str] | None = None) -> Column:
    """A key's shown name; the key itself where there is none."""
    table = F.create_map(*[F.lit(x) for pair in (names or NAMES).items() for x in pair])
    return F.coalesce(table[key], key)


def series_colour(index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, COLOURS)), (index % len(COLOURS) + 1).cast("int"))

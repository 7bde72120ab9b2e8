"""Audio variants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODECS = ("mp3", "aac")


def best_variant(variants: DataFrame, codecs: tuple[str, ...] = CODECS) -> DataFrame:
    """Per track the full variant of an allowed codec with the highest bitrate, the first one on a tie.

    ``variants`` has (id, pos, codec, preview, bitrate); previews and unknown codecs are out.
    """
    full = variants.where(F.col("preview").eqNullSafe(F.lit(False)) & F.col("codec").isin(*codecs))
    best = full.groupBy("id").agg(F.max(F.struct("bitrate", (-F.col("pos")).alias("back"), "codec")).alias("b"))
    return best.select("id", F.col("b.bitrate").alias("bitrate"), (-F.col("b.back")).alias("pos"), F.col("b.codec").alias("codec"))

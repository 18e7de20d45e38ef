"""Feature vector of a pixel."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flotsam.functions.spectral import indices
from flotsam.operators.raster import box_mean, normalise

CONTEXT = ("fdi_mean3", "fdi_std5", "b08_hp5")


def pixel_features(px: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Normalised bands ``n_*``, six indices of them, and the surroundings of the index and the near infrared.

    ``px`` carries ``bg_*`` from ``block_background``. The 5×5 windows share one pass.
    """
    px = normalise(px, bands).withColumns(indices("n_"))
    px = box_mean(px, keys, {"fdi_mean3": "fdi"}, 3)
    px = box_mean(px.withColumn("_f2", F.col("fdi") * F.col("fdi")), keys, {"_m": "fdi", "_m2": "_f2", "_m8": "n_b08"}, 5)
    return px.withColumns({"fdi_std5": F.sqrt(F.greatest(F.col("_m2") - F.col("_m") * F.col("_m"), F.lit(0.0))),
                           "b08_hp5": F.col("n_b08") - F.col("_m8")}).drop("_f2", "_m", "_m2", "_m8")


def feature_names(bands: list[str]) -> list[str]:
    return [f"n_{b}" for b in bands] + ["ndvi", "fdi", "fai", "ndwi", "pi", "ndmi", *CONTEXT]

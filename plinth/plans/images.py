"""Image metrics (F46): every vector of the embeddings table is a picture of 8 by 8 gray levels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.images import image_metrics
from ..sources.tables import table
from .registry import query


_AT = "8 * (1 + k // 6) + 2 + k % 6"  # of the inner pixels


@query("f46_image_metrics", f"""WITH p AS (SELECT vec_id AS id, [least(255, greatest(0, floor(x::DOUBLE * 256 + 128))) FOR x IN embedding] AS g FROM embeddings),
b AS (SELECT id, g, [g[{_AT} - 8] + g[{_AT} + 8] + g[{_AT} - 1] + g[{_AT} + 1] - 4 * g[{_AT}] FOR k IN range(36)] AS bend FROM p)
SELECT id, round(list_var_pop(bend), 4) AS blur, round(list_avg(g), 8) AS brightness, round(len([x FOR x IN g IF x < 20]) / 64, 8) AS dark, round(len([x FOR x IN g IF x > 235]) / 64, 8) AS bright FROM b""")
def f46(spark, d):
    gray = F.transform("embedding", lambda x: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(x.cast("double") * 256 + 128).cast("double"))))
    found = image_metrics(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(8).alias("width"), gray.alias("pixels")))
    return found.select("id", F.round("blur", 4).alias("blur"), F.round("brightness", 8).alias("brightness"), F.round("dark", 8).alias("dark"), F.round("bright", 8).alias("bright"))

"""Normalisation of semi-structured camera metadata: frame value, else container value, else a default, with its provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.functions.arrays import matrix9
from lumaframe.functions.pixel import CFA, determinant, inverse, row_norm
from lumaframe.functions.text import broadcast_levels, light_name_to_cct

NUMBERS = "array<double>"
SCHEMA = "width int, height int, compressionType int, sensorArrangment string, sensorArrangement string, blackLevel array<double>, whiteLevel double, asShotNeutral array<double>, colorMatrix1 array<double>, colorMatrix2 array<double>, calibrationMatrix1 array<double>, calibrationMatrix2 array<double>, forwardMatrix1 array<double>, forwardMatrix2 array<double>, colorIlluminant1 string, colorIlluminant2 string"
MATRICES = ("colorMatrix1", "colorMatrix2", "calibrationMatrix1", "calibrationMatrix2", "forwardMatrix1", "forwardMatrix2")


def fallback(frame: Column, container: Column, default: Column | None = None) -> tuple[Column, Column]:
    """The value and where it is from."""
    tail = F.lit("absent") if default is None else F.lit("compatibility_default")
    source = F.when(frame.isNotNull(), F.lit("frame")).when(container.isNotNull(), F.lit("container")).otherwise(tail)
    return F.coalesce(*(x for x in (frame, container, default) if x is not None)), source


def normalize(records: DataFrame) -> DataFrame:
    """records with frame_json and container_json -> one struct column meta, with a list of warnings.

    An unknown arrangement raises; missing illuminants of present matrices get 6504 and 2856 with a warning each.
    """
    parsed = records.withColumn("f", F.from_json("frame_json", SCHEMA)).withColumn("c", F.from_json("container_json", SCHEMA))
    pick = lambda name: fallback(F.col(f"f.{name}"), F.col(f"c.{name}"))
    arrangement = F.lower(F.coalesce("f.sensorArrangement", "c.sensorArrangement", "f.sensorArrangment", "c.sensorArrangment"))
    historical = F.coalesce("f.sensorArrangement", "c.sensorArrangement").isNull() & F.coalesce("f.sensorArrangment", "c.sensorArrangment").isNotNull()
    cfa = F.when(arrangement.isin(*CFA), arrangement).otherwise(F.raise_error(F.concat(F.lit("unknown sensor arrangement "), F.coalesce(arrangement, F.lit("null")))).cast("string"))
    black, white = pick("blackLevel")[0], pick("whiteLevel")[0]
    fields = [pick("width")[0].alias("width"), pick("height")[0].alias("height"), cfa.alias("cfa"), broadcast_levels(F.coalesce(black, F.array(F.lit(0.0)))).alias("black_level"), F.array_repeat(F.coalesce(white, F.lit(65535.0)), 4).alias("white_level"), pick("asShotNeutral")[0].alias("camera_neutral"), pick("compressionType")[0].alias("compression_type")]
    keys = F.map_keys(F.coalesce(F.from_json("frame_json", "map<string,string>"), F.expr("map()").cast("map<string,string>")))
    for m in MATRICES:
        # A frame's key counts even if its value is null: the container is asked only where the frame has no such key.
        value, source = fallback(matrix9(F.col(f"f.{m}")), F.when(~F.array_contains(keys, m), matrix9(F.col(f"c.{m}"))))
        fields.append(F.when(value.isNotNull(), F.struct(value.alias("values"), source.alias("source"))).alias(m))
    warnings = [F.when(historical, F.lit("historical_arrangement_key"))]
    for i, default in ((1, 6504), (2, 2856)):
        cct = light_name_to_cct(pick(f"colorIlluminant{i}")[0])
        missing = cct.isNull() & pick(f"colorMatrix{i}")[0].isNotNull()
        fields.append(F.when(missing, F.lit(float(default))).otherwise(F.coalesce(cct.cast("double"), F.lit(0.0))).alias(f"illuminant{i}_cct"))
        warnings.append(F.when(missing, F.lit(f"illuminant{i}_defaulted")))
    fields.append(F.array_compact(F.array(*warnings)).alias("warnings"))
    return parsed.withColumn("meta", F.struct(*fields)).drop("f", "c")


def raw_faults(meta: str = "meta") -> Column:
    """Reasons why the record can't be calibrated, empty if it can."""
    m = F.col(meta)
    endless = lambda x: F.isnan(x) | (F.abs(x) == float("inf"))
    levels = F.exists(F.zip_with(m["black_level"], m["white_level"], lambda b, w: F.coalesce(endless(b) | endless(w) | (w <= b), F.lit(True))), lambda x: x)
    return F.array_compact(F.array(F.when(~F.coalesce((m["width"] > 0) & (m["height"] > 0), F.lit(False)), F.lit("dimensions")), F.when(~F.coalesce(m["compression_type"].isin(6, 7), F.lit(False)), F.lit("compression")), F.when(levels, F.lit("levels"))))


def color_faults(meta: str = "meta") -> Column:
    m = F.col(meta)
    dual = m["colorMatrix2"].isNotNull() & ((m["illuminant1_cct"] <= 0) | (m["illuminant2_cct"] <= 0))
    orphan = (m["forwardMatrix1"].isNotNull() & m["colorMatrix1"].isNull()) | (m["forwardMatrix2"].isNotNull() & m["colorMatrix2"].isNull())
    return F.array_compact(F.array(F.when(m["colorMatrix1"].isNull(), F.lit("color_matrix")), F.when(dual, F.lit("illuminants")), F.when(orphan, F.lit("forward_matrix"))))


def matrix_valid(values: list[Column], limit: float = 1e8) -> Column:
    """Nine values with a determinant of 1e-12 at least and a condition (row norms) of `limit` at most."""
    safe = F.abs(determinant(values)) >= 1e-12
    return F.when(safe, row_norm(values) * row_norm(inverse(values)) <= limit).otherwise(F.lit(False))

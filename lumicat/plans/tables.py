"""The domain's tables derived from the driver's: rasters, shots, calibration frames, queue, edits.

Each is a list of (name, expression) over one source table.  The expressions are common SQL, so that the same text
derives the table for Spark and for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rasters 50 wide and 60 high from the dense order keys; in a small table the last one has fewer rows.
WIDTH, HEIGHT = 50, 60
_Y = "floor((o_orderkey % 3000) / 50)"
PIXELS = (
    "orders",
    (
        ("frame", "cast(floor(o_orderkey / 3000) as bigint)"),
        ("y", f"cast({_Y} as bigint)"),
        ("x", "cast(o_orderkey % 50 as bigint)"),
        ("v", "cast(o_totalprice as double)"),
        ("r", "cast((o_custkey * 7919 + o_orderkey) % 65536 as double)"),
        ("g", "cast((o_orderkey * 31 + o_custkey * 17) % 65536 as double)"),
        ("b", "cast((o_orderkey * 104729 + o_custkey) % 65536 as double)"),
        ("c", f"case when o_orderkey % 2 = 0 and {_Y} % 2 = 0 then 0 when o_orderkey % 2 = 1 and {_Y} % 2 = 1 then 2 else 1 end"),
    ),
)
SHOTS = (
    "part",
    (
        ("shot_id", "p_partkey"),
        ("folder", "concat('/photos/', p_brand)"),
        ("file", "concat('/photos/', p_brand, '/Shot_', cast(floor(p_partkey / 3) as bigint), case p_partkey % 3 when 0 then '.NEF' when 1 then '.jpg' else '.dng' end)"),
        ("filetype", "case p_partkey % 3 when 0 then 'nef' when 1 then 'jpg' else 'dng' end"),
        ("camera", "p_brand"),
        ("make", "substring(p_brand, 1, 5)"),
        ("model", "p_brand"),
        ("lens", "p_type"),
        ("iso", "p_size * 100"),
        ("shutter", "cast(1 as double) / (1 + p_partkey % 500)"),
        ("fnumber", "1.4e0 + (p_partkey % 20) / 2e0"),
        ("focal", "cast(10 + p_partkey % 190 as double)"),
        ("expcomp", "case p_partkey % 4 when 0 then '0.00' when 1 then '0.33' when 2 then '-1.00' else '0.67' end"),
        ("rank", "cast(p_partkey % 6 as int)"),
        ("color_label", "cast(p_size % 6 as int)"),
        ("in_trash", "p_partkey % 11 = 0"),
        ("edited", "p_partkey % 2 = 0"),
        ("recently_saved", "p_partkey % 5 = 0"),
        ("exif_valid", "p_partkey % 17 <> 0"),
        ("taken", "cast(1577836800 + (p_partkey * 7919) % 31536000 as bigint)"),
        ("ts", "cast(1577836800 + (p_partkey * 7919) % 31536000 as bigint)"),
        ("size", "cast(p_retailprice * 100 as bigint)"),
    ),
)
#: Calibration frames: a few kinds for each maker.
FRAMES = (
    "part",
    (
        ("frame_id", "p_partkey"),
        ("make", "substring(p_brand, 1, 5)"),
        ("model", "p_brand"),
        ("lens", "p_type"),
        ("iso", "(p_size % 10 + 1) * 200"),
        ("shutter", "cast(1 as double) / (1 + p_partkey % 7)"),
        ("focal", "cast(10 + p_partkey % 9 * 20 as double)"),
        ("aperture", "1.4e0 + (p_partkey % 5) * 2e0"),
        ("ts", "cast(1577836800 + (p_partkey * 104729) % 31536000 as bigint)"),
    ),
)
QUEUE = (
    "orders",
    (
        ("entry", "concat('job-', cast(o_orderkey as bigint))"),
        ("seq", "o_orderkey"),
        ("processing", "o_orderkey < 2"),
        ("selected", "o_orderpriority = '1-URGENT'"),
    ),
)
EDITS = (
    "events",
    (
        ("image", "user_id"),
        ("seq", "event_id"),
        ("event", "event_type"),
        ("params", "value"),
    ),
)


def table(spark: SparkSession, sf_dir: str, spec: tuple, where: str | None = None) -> DataFrame:
    source, columns = spec
    rows = spark.read.parquet(f"{sf_dir}/{source}.parquet")
    if where:
        rows = rows.where(where)
    return rows.selectExpr(*[f"{e} as {n}" for n, e in columns])


def sql(spec: tuple, where: str | None = None) -> str:
    source, columns = spec
    return "(select " + ", ".join(f"{e} as {n}" for n, e in columns) + f" from {source}{' where ' + where if where else ''})"

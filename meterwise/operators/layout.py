"""Physical layout of series: how a sensor's rows are spread over tasks.

The semantics are positional (rolling frames count rows, interpolation is by
row position, the seasonal phase is position mod period), but a window
``partitionBy('sensor_id')`` would put a whole sensor into one task, and one
sensor may hold a large share of all rows.  So a series is processed in two
bounded layouts:

1. **Time chunks** (``clean_series``): each sensor's rows are cut, in order, into
   ``ceil(n / chunk_rows)`` chunks of about equal size (``with_chunks``).  Rows are ordered inside a chunk;
   a small per-chunk summary table (one row per chunk) gives every chunk its
   global row offset and the last / next valid value outside it, so positions
   and interpolation across chunk borders are exact.
2. **Position blocks** (``to_blocks``): cleaned rows are keyed by
   ``pos div block_rows``; the last ``halo_back`` rows of a block are copied
   into the next block and the first ``halo_forward`` rows into the previous
   one.  Every bounded frame (rolling 168 rows, lag 168, centred trend) is then
   complete inside one ``(sensor_id, blk)`` window partition.

Per-sensor statistics are ordinary partial aggregates; they are brought back
to the rows by ``attach_per_sensor``, which replicates the (small) statistics
row to each of the sensor's blocks and joins on ``(sensor_id, blk)`` — the
key the rows are already partitioned by, so the big side never shuffles again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import DetectionConfig
from ..functions.time import epoch_micros

CORE, HALO_BACK, HALO_FWD = 0, 1, 2
RESERVED = ("sensor_id", "timestamp", "value", "row_id")


def _lead_ignore_nulls(col: str) -> Column:
    # lead(...) IGNORE NULLS is linear in Spark; a first(...) over an
    # unbounded-following frame would be quadratic.
    return F.expr(f"lead({col}, 1) IGNORE NULLS")


def _running(w):
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def passthrough_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in RESERVED]


#: Sampled rows a chunk: a chunk's rows then differ from ``chunk_rows`` by about an eighth.
SAMPLES = 64
_DAY_US = 86_400_000_000


def with_chunks(r: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Adds ``chunk``: the sensor's rows in order of (t_us, row_id, value), cut into parts of about ``chunk_rows`` rows.

    The cuts are quantiles of a sample of the rows' keys (by hash, ``SAMPLES`` a chunk), so bursts, many rows of one time and
    stray dates give even chunks too; only rows that are equal in all three cannot be parted.  Cuts travel to the rows by
    (sensor, day), each day with the cuts that lie in it: a sensor's rows are not gathered for that."""
    key = F.struct(F.col("t_us").alias("t"), F.col("row_id").alias("r"), F.col("value").alias("v"))
    sampled = F.pmod(F.xxhash64("t_us", "row_id", "value"), F.lit(max(cfg.chunk_rows, 1))) < SAMPLES
    r = r.withColumn("_day", F.floor(F.col("t_us") / _DAY_US))
    days = r.groupBy("sensor_id", "_day").agg(F.count(F.lit(1)).alias("rows"), F.collect_list(F.when(sampled, key)).alias("some"))
    whole = days.groupBy("sensor_id").agg(F.sum("rows").alias("rows"), F.array_sort(F.flatten(F.collect_list("some"))).alias("some"))
    parts, m = F.ceil(F.col("rows") / F.lit(cfg.chunk_rows)), F.size("some")
    every = F.transform(F.sequence(F.lit(1).cast("bigint"), parts - 1), lambda i: F.get("some", F.floor(i * m / parts).cast("int")))
    whole = whole.select("sensor_id", F.when((parts > 1) & (m > 0), F.array_distinct(every)).otherwise(F.slice("some", 1, 0)).alias("cuts"))
    start = F.col("_day") * _DAY_US
    days = days.select("sensor_id", "_day").join(whole, "sensor_id").select(
        "sensor_id", "_day", F.size(F.filter("cuts", lambda c: c["t"] < start)).alias("_before"),
        F.filter("cuts", lambda c: (c["t"] >= start) & (c["t"] < start + _DAY_US)).alias("_cuts"))
    r = r.join(days, ["sensor_id", "_day"])
    # binary search for the number of cuts up to the row
    bits = F.ceil(F.log2(F.size("_cuts") + 1)).cast("int")
    steps = F.transform(F.sequence(F.lit(1), bits), lambda k: F.pow(F.lit(2), bits - k).cast("int"))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when((at + step <= F.size("_cuts")) & (F.get("_cuts", at + step - 1) <= key), at + step).otherwise(at))
    up_to = F.when(F.size("_cuts") == 0, F.lit(0)).otherwise(found)
    return r.withColumn("chunk", (F.col("_before") + up_to).cast("bigint")).drop("_day", "_before", "_cuts")


def clean_series(readings: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """T1 -> W4/W5 -> F2 for all sensors at once.

    Returns the kept rows with ``value`` interpolated, ``value_raw``,
    ``imputed``, ``pos`` (0-based position among kept rows of the sensor, in
    ``(timestamp, row_id, value)`` order) and ``n`` (kept rows of the sensor).
    """
    method = cfg.interpolation
    extras = passthrough_columns(readings)
    r = readings.withColumn("t_us", epoch_micros("timestamp"))

    r = with_chunks(r, cfg)
    # Explicit exchange on the full key: an upstream partitioning by
    # sensor_id alone would otherwise satisfy the window and keep a whole
    # sensor in one task.
    r = r.repartition("sensor_id", "chunk")

    # --- ordered pass inside chunks ------------------------------------------
    wc = Window.partitionBy("sensor_id", "chunk").orderBy("timestamp", "row_id", "value")
    wr = _running(wc)
    valid = F.col("value").isNotNull()
    extras_ok = F.lit(True)
    for c in extras:
        extras_ok = extras_ok & F.col(c).isNotNull()
    r = (r.withColumn("li", F.row_number().over(wc) - 1)
          .withColumn("_valid", valid)
          .withColumn("_vli", F.when(valid, F.col("li")))
          .withColumn("_vus", F.when(valid, F.col("t_us")))
          .withColumn("_xok", extras_ok))
    r = r.select(
        "*",
        F.last("value", ignorenulls=True).over(wr).alias("lp_val"),
        F.last("_vli", ignorenulls=True).over(wr).alias("lp_idx"),
        F.last("_vus", ignorenulls=True).over(wr).alias("lp_us"),
        _lead_ignore_nulls("value").over(wc).alias("ln_val"),
        _lead_ignore_nulls("_vli").over(wc).alias("ln_idx"),
        _lead_ignore_nulls("_vus").over(wc).alias("ln_us"),
    )
    has_lp = F.col("lp_val").isNotNull()
    has_ln = F.col("_valid") | F.col("ln_val").isNotNull()
    cats = {
        "pn": F.col("_xok") & has_lp & has_ln,
        "p_": F.col("_xok") & has_lp & ~has_ln,
        "_n": F.col("_xok") & ~has_lp & has_ln,
        "__": F.col("_xok") & ~has_lp & ~has_ln,
    }
    r = r.select("*", *[F.sum(F.when(c, 1).otherwise(0)).over(wr).alias(f"r{k}")
                        for k, c in cats.items()])

    # --- chunk summary: offsets, carries, kept counts -------------------------
    summ = (r.groupBy("sensor_id", "chunk").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min_by(F.struct(F.col("value").alias("v"), F.col("li").alias("i"), F.col("t_us").alias("us")),
                 F.col("_vli")).alias("fv"),
        F.max_by(F.struct(F.col("value").alias("v"), F.col("li").alias("i"), F.col("t_us").alias("us")),
                 F.col("_vli")).alias("lv"),
        *[F.sum(F.when(c, 1).otherwise(0)).alias(f"c{k}") for k, c in cats.items()]))
    ws = Window.partitionBy("sensor_id").orderBy("chunk")
    before = ws.rowsBetween(Window.unboundedPreceding, -1)
    summ = summ.withColumn("off", F.coalesce(F.sum("cnt").over(before), F.lit(0)))
    gstruct = lambda s: F.when(F.col(s).isNotNull(), F.struct(
        F.col(f"{s}.v").alias("v"), (F.col("off") + F.col(f"{s}.i")).alias("g"), F.col(f"{s}.us").alias("us")))
    summ = summ.withColumn("fvg", gstruct("fv")).withColumn("lvg", gstruct("lv"))
    summ = summ.select(
        "*",
        F.last("lvg", ignorenulls=True).over(before).alias("ci"),
        _lead_ignore_nulls("fvg").over(ws).alias("co"),
    )
    hci, hco = F.col("ci").isNotNull(), F.col("co").isNotNull()
    if method == "nearest":
        kept = lambda p: (F.col(f"{p}pn") + F.when(hco, F.col(f"{p}p_")).otherwise(0)
                          + F.when(hci, F.col(f"{p}_n")).otherwise(0)
                          + F.when(hci & hco, F.col(f"{p}__")).otherwise(0))
    else:
        kept = lambda p: (F.col(f"{p}pn") + F.col(f"{p}p_")
                          + F.when(hci, F.col(f"{p}_n") + F.col(f"{p}__")).otherwise(0))
    summ = summ.withColumn("kept", kept("c"))
    summ = (summ.withColumn("koff", F.coalesce(F.sum("kept").over(before), F.lit(0)))
                .withColumn("n", F.sum("kept").over(Window.partitionBy("sensor_id")))
                .select("sensor_id", "chunk", "off", "ci", "co", "koff", "n"))

    # --- rows: global positions, interpolation, kept rank ---------------------
    r = r.join(summ, ["sensor_id", "chunk"])
    pos0 = F.col("off") + F.col("li")
    pv = F.when(has_lp, F.col("lp_val")).otherwise(F.col("ci.v"))
    pg = F.when(has_lp, F.col("off") + F.col("lp_idx")).otherwise(F.col("ci.g"))
    pus = F.when(has_lp, F.col("lp_us")).otherwise(F.col("ci.us"))
    nv = F.when(F.col("ln_val").isNotNull(), F.col("ln_val")).otherwise(F.col("co.v"))
    ng = F.when(F.col("ln_val").isNotNull(), F.col("off") + F.col("ln_idx")).otherwise(F.col("co.g"))
    nus = F.when(F.col("ln_val").isNotNull(), F.col("ln_us")).otherwise(F.col("co.us"))
    if method == "linear":
        frac = F.try_divide((pos0 - pg).cast("double"), (ng - pg).cast("double"))
        fill = F.when(nv.isNull(), pv).otherwise(pv + (nv - pv) * frac)
    elif method == "time":
        frac = F.try_divide((F.col("t_us") - pus).cast("double"), (nus - pus).cast("double"))
        fill = F.when(nv.isNull(), pv).otherwise(pv + (nv - pv) * F.coalesce(frac, F.lit(0.0)))
    elif method == "ffill":
        fill = pv
    else:  # nearest: ties go to the earlier point, no extrapolation
        fill = F.when(nv.isNull(), F.lit(None).cast("double")).otherwise(
            F.when((pos0 - pg) <= (ng - pos0), pv).otherwise(nv))
    value = F.when(F.col("_valid"), F.col("value")).otherwise(F.when(pv.isNotNull(), fill))
    pos = F.col("koff") + kept("r") - 1
    out = (r.select(
        "sensor_id", "timestamp", "row_id", value.alias("value"),
        F.col("value").alias("value_raw"), (~F.col("_valid")).alias("imputed"),
        *extras, pos.alias("pos"), "n", "_xok")
        .filter(F.col("value").isNotNull() & F.col("_xok"))
        .drop("_xok"))
    return out


def min_points_guard(clean: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """sensors with fewer than ``min_points`` cleaned rows give nothing."""
    if cfg.min_points <= 0:
        return clean
    return clean.filter(F.col("n") >= cfg.min_points)


def to_blocks(clean: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """Position blocks with the halos of the engine's own frames."""
    return with_halo(clean, cfg.block_rows, cfg.halo_back, cfg.halo_forward)


def with_halo(clean: DataFrame, block_rows: int, back: int, ahead: int) -> DataFrame:
    """Key rows (with ``pos`` and the sensor's row count ``n``) by position block and copy halo rows to the blocks that need
    them: those of the ``back`` rows after a row and of the ``ahead`` rows before it.

    Output column ``role``: 0 core, 1 copy for a later block, 2 copy for an earlier one.  Windows over ``block_window()``
    see every frame whole for core rows."""
    B = block_rows
    blk = F.floor(F.col("pos") / B).cast("bigint")
    rem, last = F.col("pos") - blk * B, F.floor((F.col("n") - 1) / B).cast("bigint")
    copies = [F.array(F.struct(blk.alias("blk"), F.lit(CORE).alias("role")))]
    for k in range(1, -(-back // B) + 1):
        copies.append(F.when((rem + back >= k * B) & (blk + k <= last), F.array(F.struct((blk + k).alias("blk"), F.lit(HALO_BACK).alias("role")))))
    for k in range(1, -(-ahead // B) + 1):
        copies.append(F.when((rem - ahead < (1 - k) * B) & (blk >= k), F.array(F.struct((blk - k).alias("blk"), F.lit(HALO_FWD).alias("role")))))
    none = F.array().cast("array<struct<blk:bigint,role:int>>")
    out = (clean.drop("blk").withColumn("_cp", F.explode(F.concat(*[F.coalesce(c, none) for c in copies])))
                .select("*", F.col("_cp.blk").alias("blk"), F.col("_cp.role").alias("role"))
                .drop("_cp"))
    # exchange on (sensor_id, blk) explicitly, for the same reason as above
    return out.repartition("sensor_id", "blk")


def block_window():
    return Window.partitionBy("sensor_id", "blk").orderBy("pos")


def core_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("role") == CORE).drop("role")


def sensor_blocks(per_sensor: DataFrame, cfg: DetectionConfig) -> DataFrame:
    """One row per (sensor, block) carrying the sensor's statistics; needs
    the sensor's kept-row count ``n``."""
    nblk = F.ceil(F.col("n") / F.lit(cfg.block_rows))
    return per_sensor.withColumn(
        "blk", F.explode(F.sequence(F.lit(0).cast("bigint"), (nblk - 1).cast("bigint"))))


def attach_per_sensor(rows: DataFrame, per_sensor: DataFrame, cfg: DetectionConfig | None = None,
                      how: str = "left") -> DataFrame:
    """Bring per-sensor statistics onto the rows without re-shuffling the
    rows.  The statistics row is replicated to each of the sensor's blocks
    and joined on ``(sensor_id, blk)``, the key the rows are already
    partitioned by: only the small side moves.  With the sensor's row count
    ``n`` in ``per_sensor`` the block list is generated; otherwise it is a
    distinct over the rows' own partitioning key (no exchange either)."""
    if cfg is not None and "n" in per_sensor.columns:
        per_block = sensor_blocks(per_sensor, cfg)
    else:
        blocks = rows.select("sensor_id", "blk").distinct()
        per_block = blocks.join(per_sensor, "sensor_id", "inner")
    if "n" in per_block.columns:
        per_block = per_block.drop("n")
    return rows.join(per_block, ["sensor_id", "blk"], how)

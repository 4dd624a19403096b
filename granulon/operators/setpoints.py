"""Setpoint sequences of a piezo stage, and mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _rows(spark: SparkSession, n: int, value: str) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("k"), F.expr(value).alias("target"))


def ramp(spark: SparkSession, start: float, stop: float, n: int) -> DataFrame:
    return _rows(spark, n, f"{start}D + id * {(stop - start) / max(n - 1, 1)}D")


def triangle(spark: SparkSession, low: float, high: float, n_half: int) -> DataFrame:
    """Up and down again, the peak once."""
    return _rows(spark, 2 * n_half + 1, f"{low}D + ({n_half} - abs(id - {n_half})) * {(high - low) / n_half}D")


def hold(spark: SparkSession, value: float, n: int) -> DataFrame:
    return _rows(spark, n, f"{value}D")


def up_hold_down(spark: SparkSession, low: float, high: float, n_ramp: int, n_hold: int) -> DataFrame:
    return _rows(spark, 2 * n_ramp + n_hold, f"case when id < {n_ramp} then {low}D + id * {(high - low) / n_ramp}D when id < {n_ramp + n_hold} then {high}D else {high}D - (id - {n_ramp + n_hold - 1}) * {(high - low) / n_ramp}D end")


def oscillate(spark: SparkSession, centre: float, amplitude: float, period: int, n: int, half_wave: bool = False) -> DataFrame:
    wave = f"sin(2 * pi() * id / {period})"
    return _rows(spark, n, f"{centre}D + {amplitude}D * {f'abs({wave})' if half_wave else wave}")


def sweep(spark: SparkSession, amplitudes: list[float], repeats: int) -> DataFrame:
    """Out to each amplitude and back, so many times."""
    a = ", ".join(f"{x}D" for x in amplitudes)
    return spark.sql(f"select row_number() over (order by i, r, s) - 1 as k, if(s = 0, amp, 0D) as target from (select posexplode(array({a})) as (i, amp)), (select explode(sequence(1, {repeats})) as r), (select explode(array(0, 1)) as s)")


def mass_fraction(rows: DataFrame, master: str, solute: str, solvent: str, share: float = 1.0067 / (1.0667 + 4.0954)) -> DataFrame:
    """The solute's share of a mixture's mass, where a master batch holds a known share of it as well; null for an empty mixture."""
    total = F.col(master) + F.col(solute) + F.col(solvent)
    return rows.withColumn("mass_fraction", F.try_divide(F.col(solute) + share * F.col(master), total))


def bump_pause_bump(spark: SparkSession, low: float, high: float, n_half: int, n_pause: int) -> DataFrame:
    """A triangle, a pause at its start, and the triangle again."""
    bump, n = f"{low}D + ({n_half} - abs({{k}} - {n_half})) * {(high - low) / n_half}D", 2 * n_half + 1
    return _rows(spark, 2 * n + n_pause, f"case when id < {n} then {bump.format(k='id')} when id < {n + n_pause} then {low}D else {bump.format(k=f'(id - {n + n_pause})')} end")


def liquid_filler(rows: DataFrame, parts: dict[str, float], filler: str) -> DataFrame:
    """Liquid share of a mixture: of each part (column: its reactive weight share) what does not react, and the filler, over all."""
    liquid = sum((F.col(c) * (1 - w) for c, w in parts.items()), F.col(filler))
    return rows.withColumn("liquid_fraction", F.try_divide(liquid, sum((F.col(c) for c in parts), F.col(filler))))

"""Quality gates: thresholds on profile columns. All thresholds are inclusive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.errors import GateError
from fleetlens.functions.columns import fixed

CHECK = "struct<name:string,passed:boolean,message:string,threshold:double,observed:double>"


@dataclass(frozen=True)
class Gate:
    min_rows: int = 30
    max_missing_rate: float = 0.25
    max_outlier_ratio: float = 0.20
    max_spike_ratio: float = 0.15
    max_flatline_ratio: float = 0.50
    max_sampling_irregularity: float = 0.60
    min_coverage_ratio: float = 0.0
    max_gap_seconds: float | None = None

    def __post_init__(self) -> None:
        shares = {k: v for k, v in vars(self).items() if k not in ("min_rows", "max_gap_seconds")}
        wrong = [f"{k} {v} (a share is from 0 to 1)" for k, v in shares.items() if not 0 <= v <= 1]
        wrong += [f"min_rows {self.min_rows} (from 1 on)"] * (self.min_rows < 1) + [f"max_gap_seconds {self.max_gap_seconds} (above 0, or None)"] * (self.max_gap_seconds is not None and self.max_gap_seconds <= 0)
        if wrong:
            raise GateError("no gate with " + ", ".join(wrong))

    def limits(self) -> list[tuple[str, str, bool, float, int | None]]:
        """Name, profile column, whether it is a floor, threshold, and decimals in messages, of the checks in order."""
        rates = ("missing_rate", "outlier_ratio", "spike_ratio", "flatline_ratio", "sampling_irregularity")
        out: list = [("min_rows", "effective_row_count", True, self.min_rows, None), *((r, r, False, getattr(self, f"max_{r}"), 3) for r in rates)]
        if self.min_coverage_ratio > 0:
            out.append(("min_coverage_ratio", "coverage_ratio", True, self.min_coverage_ratio, 3))
        if self.max_gap_seconds is not None:
            out.append(("max_gap_seconds", "max_gap_seconds", False, self.max_gap_seconds, 1))
        return out

    def checks(self) -> Column:
        """An array of CHECK. The texts are made in a lambda, so that each metric is computed once however often a check shows it."""
        rows = []
        for name, column, floor, threshold, decimals in self.limits():
            words = (" >= ", " below minimum ") if floor else (" <= ", " exceeds maximum ")
            bound = str(threshold) if decimals is None else f"{threshold:.{decimals}f}"
            fields = {"name": name, "label": "effective rows" if decimals is None else column, "floor": floor, "threshold": float(threshold), "decimals": -1 if decimals is None else decimals, "good": words[0] + bound, "bad": words[1] + bound}
            rows.append(F.struct(F.col(column).cast("double").alias("observed"), *[F.lit(v).alias(k) for k, v in fields.items()]))

        def told(c: Column) -> Column:
            passed = F.when(c["floor"], c["observed"] >= c["threshold"]).otherwise(c["observed"] <= c["threshold"])
            shown = F.when(c["decimals"] < 0, c["observed"].cast("long").cast("string")).when(c["decimals"] == 1, fixed(c["observed"], 1)).otherwise(fixed(c["observed"], 3))
            message = F.concat(c["label"], F.lit(" "), shown, F.when(passed, c["good"]).otherwise(c["bad"]))
            return F.struct(c["name"].alias("name"), passed.alias("passed"), message.alias("message"), c["threshold"].alias("threshold"), c["observed"].alias("observed"))

        return F.transform(F.array(*rows), told)


#: The thresholds of fleet evaluations, for sparse field data.
EVALUATION = Gate(min_rows=100, min_coverage_ratio=0.15, max_missing_rate=0.55, max_sampling_irregularity=0.80)


def gated(profiles: DataFrame, gate: Gate | None = None) -> DataFrame:
    """profiles with checks, gate_passed and gate_failures (names)."""
    checks = profiles.withColumn("checks", (gate or Gate()).checks())
    return checks.withColumns({"gate_passed": F.forall("checks", lambda c: c["passed"]), "gate_failures": F.transform(F.filter("checks", lambda c: ~c["passed"]), lambda c: c["name"])})

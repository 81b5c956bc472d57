"""The rule table, compiled to columns, and recommendations from it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.gate import Gate, gated

RECIPE = "struct<priority:int,model:string,reason:string,family:string,parameters:map<string,string>,tags:array<string>>"


@dataclass(frozen=True)
class Rule:
    model: str
    family: str
    priority: int
    reason: str
    when: Callable[[], Column]
    parameters: Callable[[], dict[str, Column]]


def _c(name: str) -> Column:
    return F.col(name)


def _rounded(name: str) -> Column:
    return F.round(name, 3).cast("string")


def clamped(rows: Column, divisor: int, low: int, high: int) -> Column:
    """A tenth or fifth of the rows, say, within bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(rows / divisor))).cast("string")


def _starved() -> Column:
    return (_c("coverage_ratio") < 0.30) & (_c("effective_row_count") < 50)


def _sparse() -> Column:
    return (_c("coverage_ratio") < 0.60) & (_c("sampling_irregularity") >= 0.35)


def _patterned(at: float) -> Column:
    return (_c("trend_strength") >= at) | (_c("seasonality_strength") >= at)


# Models, families, priorities, reasons, thresholds and parameters, which users' results must have as they are.
RULES = (
    Rule("insufficient_data", "gate", 1, "Coverage and history are too low for reliable architecture selection; collect more readings or widen the calendar window.", _starved,
         lambda: {"coverage_ratio": _rounded("coverage_ratio"), "effective_row_count": _c("effective_row_count").cast("string")}),
    Rule("naive", "baseline", 8, "Sparse irregular series; last-value baseline is the safest default.", _sparse,
         lambda: {"strategy": F.lit("last_value"), "coverage_ratio": _rounded("coverage_ratio")}),
    Rule("naive", "baseline", 10, "Stable series with weak trend and seasonality.", lambda: (_c("trend_strength") < 0.25) & (_c("seasonality_strength") < 0.25) & (_c("volatility") < 0.40) & ~_sparse(),
         lambda: {"strategy": F.lit("last_value")}),
    Rule("moving_average", "baseline", 20, "Low volatility and few spikes suit a smoothed baseline.", lambda: (_c("volatility") < 0.45) & (_c("spike_ratio") < 0.10) & (_c("flatline_ratio") < 0.35),
         lambda: {"window": clamped(_c("row_count"), 10, 3, 28)}),
    Rule("exponential_smoothing", "statistical", 30, "Trend or seasonality present with moderate volatility.", lambda: _patterned(0.20) & (_c("volatility") < 0.55) & (_c("sampling_irregularity") < 0.50),
         lambda: {"seasonal": (_c("seasonality_strength") >= 0.20).cast("string"), "trend": (_c("trend_strength") >= 0.20).cast("string")}),
    Rule("lstm", "deep", 40, "Sufficient history and structured temporal patterns for LSTM.", lambda: (_c("effective_row_count") >= 100) & (_c("coverage_ratio") >= 0.50) & _patterned(0.30) & (_c("volatility") >= 0.25),
         lambda: {"sequence_length": clamped(_c("row_count"), 5, 12, 96)}),
    Rule("gru", "deep", 45, "Medium-length series with patterns suitable for a lighter recurrent model.", lambda: (_c("effective_row_count") >= 60) & (_c("effective_row_count") < 250) & (_c("coverage_ratio") >= 0.50) & _patterned(0.20) & (_c("volatility") < 0.70),
         lambda: {"sequence_length": clamped(_c("row_count"), 5, 12, 96)}),
    Rule("residual_lstm", "deep", 15, "High volatility with outliers or spikes; residual learning helps.", lambda: (_c("volatility") >= 0.45) & ((_c("spike_ratio") >= 0.05) | (_c("outlier_ratio") >= 0.05)) & (_c("effective_row_count") >= 80),
         lambda: {"residual_baseline": F.lit("moving_average"), "volatility_hint": _rounded("volatility")}),
    Rule("cnn_lstm", "deep", 5, "High volatility and frequent spikes detected.", lambda: (_c("volatility") >= 0.50) & (_c("spike_ratio") >= 0.08) & (_c("effective_row_count") >= 120),
         lambda: {"conv_filters": F.lit("32"), "spike_ratio_hint": _rounded("spike_ratio")}),
)
TAGS = {
    "insufficient_data": ("gate", "sparse"),
    "naive": ("baseline", "simple"),
    "moving_average": ("baseline", "smooth"),
    "exponential_smoothing": ("statistical", "smoothing"),
    "lstm": ("deep", "recurrent"),
    "gru": ("deep", "recurrent"),
    "residual_lstm": ("deep", "recurrent", "robust"),
    "cnn_lstm": ("deep", "recurrent", "convolutional", "robust"),
}
NO_MATCH = "No supported architecture matched; series may need preprocessing."
NO_DATA = "Insufficient data for architecture selection."
GATE_FAILED = "Validation gate failed; resolve data quality issues before modeling."


def matches() -> Column:
    """The matching rules as an array of RECIPE, by priority and model. Starved series match that rule alone."""
    out = []
    for rule in RULES:
        where = rule.when() if rule.model == "insufficient_data" else rule.when() & ~_starved()
        pairs = [x for k, v in rule.parameters().items() for x in (F.lit(k), v)]
        recipe = F.struct(F.lit(rule.priority).alias("priority"), F.lit(rule.model).alias("model"), F.lit(rule.reason).alias("reason"), F.lit(rule.family).alias("family"), F.create_map(*pairs).alias("parameters"), F.array(*map(F.lit, TAGS[rule.model])).alias("tags"))
        out.append((rule.priority, rule.model, F.when(where, recipe)))
    ranked = [column for _, _, column in sorted(out, key=lambda x: x[:2])]  # priorities are constants, so the order is known here
    return F.filter(F.array(*ranked), lambda r: r.isNotNull())


def summary(found: Column) -> Column:
    """One sentence or two from the first matches."""
    first, second = F.get(found, F.lit(0))["reason"], F.get(found, F.lit(1))["reason"]
    both = F.concat(first, F.lit(" Also consider: "), F.lower(F.rtrim(second, F.lit("."))), F.lit("."))
    return F.when(F.size(found) == 0, NO_MATCH).when(F.size(found) == 1, first).otherwise(both)


def advised(profiles: DataFrame, *, max_models: int = 3) -> DataFrame:
    """profiles with candidates, recommended_models, best_model, reason, reasons. Series without values get none."""
    if max_models < 1:
        raise ValueError("max_models must be at least 1")
    empty = F.array().cast(f"array<{RECIPE}>")
    found = profiles.withColumn("candidates", F.when(F.col("effective_row_count") > 0, F.slice(matches(), 1, max_models)).otherwise(empty))
    named = found.withColumn("recommended_models", F.transform("candidates", lambda r: r["model"]))
    reason = F.when(F.col("effective_row_count") > 0, summary(F.col("candidates"))).otherwise(NO_DATA)
    reasons = F.map_from_entries(F.transform("candidates", lambda r: F.struct(r["model"], r["reason"])))
    return named.withColumns({"best_model": F.get("recommended_models", F.lit(0)), "reason": reason, "reasons": reasons})


def selected(profiles: DataFrame, gate: Gate | None = None, *, max_models: int = 3) -> DataFrame:
    """The whole workflow: gate first; what fails gets no models and a fixed reason."""
    ready = advised(gated(profiles, gate), max_models=max_models)
    passed = F.col("gate_passed")
    none = F.array().cast("array<string>")
    return ready.withColumns({
        "candidates": F.when(passed, F.col("candidates")).otherwise(F.array().cast(f"array<{RECIPE}>")), "recommended_models": F.when(passed, F.col("recommended_models")).otherwise(none), "best_model": F.when(passed, F.col("best_model")),
        "reason": F.when(passed, F.col("reason")).otherwise(GATE_FAILED), "reasons": F.when(passed, F.col("reasons")).otherwise(F.map_from_entries(F.array().cast("array<struct<a:string,b:string>>"))),
    })


def recommended(profiles: DataFrame, *, max_models: int = 3) -> DataFrame:
    """entity, place (from 0), model: the recommendation alone."""
    return advised(profiles, max_models=max_models).select("entity", F.posexplode("recommended_models").alias("place", "model"))


def tags_of(model: Column) -> Column:
    """The tags of a model by name; none for an unknown one."""
    table = F.create_map(*[x for name, tags in TAGS.items() for x in (F.lit(name), F.array(*map(F.lit, tags)))])
    return F.coalesce(F.try_element_at(table, model), F.array().cast("array<string>"))


def recipe_payload(recipe: Column) -> Column:
    """A candidate as JSON."""
    return F.to_json(recipe)


def recommendation_payload() -> Column:
    """A recommendation with its candidates as JSON."""
    return F.to_json(F.struct("recommended_models", "best_model", "reason", "reasons", "candidates"))


def payload() -> Column:
    """A selection as JSON; gate failures appear only if there are any."""
    return F.to_json(F.struct("recommended_models", "reason", "reasons", "best_model", "gate_passed", F.when(F.size("gate_failures") > 0, F.col("gate_failures")).alias("gate_failures")))

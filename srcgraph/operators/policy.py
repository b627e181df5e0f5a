"""Feature policies: which classes are refused, and what hints go with the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECURITY = "EnableMethodSecurity EnableWebSecurity PostAuthorize PostFilter PreAuthorize PreFilter RolesAllowed Secured WithMockUser".split()


def security_hits(annotations) -> Column:
    tags = F.array(*map(F.lit, SECURITY))
    return F.array_sort(F.array_intersect(F.coalesce(annotations, F.array().cast("array<string>")), tags))


def returns(types, word: str) -> Column:
    """Whether any of the return types has the word, such as Mono<."""
    return F.coalesce(F.exists(types, lambda t: F.contains(t, F.lit(word))), F.lit(False))


def decide(classes: DataFrame, annotations="annotations", return_types="return_types", security: str = "refuse", webflux: str = "translate_mono_only") -> DataFrame:
    """Add decision (render or refuse), reason, stub and hints.

    ``security`` is refuse, stub_todo or ignore; ``webflux`` refuse, translate_mono_only or best_effort.
    Security comes before reactive types.
    """
    hits, mono, flux = security_hits(F.col(annotations)), returns(F.col(return_types), "Mono<"), returns(F.col(return_types), "Flux<")
    secured, none = F.size(hits) > 0, F.lit(None).cast("string")
    reason = none
    if webflux == "refuse":
        reason = F.when(mono | flux, "webflux_refuse")
    elif webflux == "translate_mono_only":
        reason = F.when(flux, "webflux_flux_only")
    if security == "refuse":
        reason = F.when(secured, "security").otherwise(reason)
    guard = F.when(secured, F.concat(F.lit("Security annotations: "), F.array_join(hits, ", "), F.lit(". Emit a guard stub and a TODO for the real guard."))) if security == "stub_todo" else none
    how = {"translate_mono_only": "Reactive return types: turn Mono<T> into Promise<T>, without RxJS.", "best_effort": "Reactive return types: turn Mono<T> into Promise<T> and Flux<T> into Observable<T>; mark doubtful cases as TODO."}
    flow = F.when(mono | flux, how[webflux]) if webflux in how else none
    out = classes.withColumn("reason", reason)
    refused = F.col("reason").isNotNull()
    return out.withColumns({"decision": F.when(refused, "refuse").otherwise("render"), "stub": ~refused & secured & F.lit(security == "stub_todo"), "hints": F.when(~refused, F.struct(guard.alias("security_hint"), flow.alias("webflux_hint")))})

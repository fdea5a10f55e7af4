"""The model registry as tables: admission, promotion, rejection, loading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chains import fold, let
from .features import KEYS

#: Fixed order of the checks of a stored model.
COMPATIBLE = ("dem_hash", "crs_hash", "coordinate_hash", "conductor_hash", "feature_version", "correction_config_hash", "training_contract_hash", "backend_id")
KEPT_REJECTIONS, KEPT_GENERATIONS = 64, 2


def admission(df: DataFrame) -> DataFrame:
    """Adds admission_reason, null for a candidate that may go on."""
    reason = F.when(F.col("outcome").startswith("operational"), "operational_training_fallback")
    reason = reason.when((F.col("evaluation") == "holdout") & F.col("evaluation_set_hash").isNull(), "missing_evaluation_set_hash")
    return df.withColumn("admission_reason", reason.when(~(F.col("corrected_mae") < F.col("baseline_mae")), "candidate_not_better_than_physical"))


#: What is held against each other of a candidate and of its key's champion.
COMPARED = ("model_version", "evaluation", "evaluation_set_hash", "training_contract_hash", "baseline_mae", "corrected_mae")


def _reason(c: Callable[[str], Column], h: Callable[[str], Column], least: float) -> Column:
    """Why the candidate with the columns c is promoted over the champion with the columns h, or why not."""
    gain_physical = c("baseline_mae") - c("corrected_mae")
    gain_head = h("corrected_mae") - c("corrected_mae")
    provisional = h("evaluation") == "full_fit"
    conflict = c("expected_version").isNotNull() & (c("expected_version") != h("model_version"))
    contract = c("training_contract_hash") != h("training_contract_hash")
    return (
        F.when(c("admission_reason").isNotNull(), c("admission_reason"))
        .when(h("model_version").isNull(), F.when(c("evaluation") == "full_fit", "promoted_provisional").otherwise("promoted"))
        .when((c("evaluation") == "full_fit"), "full_fit_cannot_replace_champion")
        .when(provisional & conflict, "model_version_conflict")
        .when(provisional & (gain_physical <= least + 1e-12), "insufficient_mae_improvement")
        .when(provisional, "promoted_from_provisional")
        .when(h("evaluation_set_hash").isNull(), "champion_has_no_independent_evaluation")
        .when(c("evaluation_set_hash") != h("evaluation_set_hash"), "evaluation_set_mismatch")
        .when(contract & (gain_head < -1e-12), "insufficient_mae_improvement")
        .when(contract, "promoted_contract_refresh")
        .when(conflict, "model_version_conflict")
        .when(gain_head <= least + 1e-12, "insufficient_mae_improvement")
        .otherwise("promoted")
    )


def decide(candidates: DataFrame, heads: DataFrame, least: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """promote and reason for every candidate, held against its key's champion (each of them, where the table has several).

    Both sides hold KEYS, model_version, evaluation, evaluation_set_hash, training_contract_hash,
    baseline_mae, corrected_mae; candidates expected_version too.  Candidates of one key are each held against
    the same champion; ``promote`` takes them one after the other.  keep: more columns of the champion that stay, as head_...
    """
    h = heads.select(*KEYS, *[F.col(c).alias("head_" + c) for c in (*COMPARED, *keep)])
    df = admission(candidates).join(h, list(KEYS), "left")
    return df.withColumn("reason", _reason(F.col, lambda x: F.col("head_" + x), least)).withColumn("promote", F.col("reason").startswith("promoted"))


def promote(candidates: DataFrame, heads: DataFrame | None = None, least: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """All candidates, each held against the champion that the ones before it left: (decisions, heads).

    candidates: KEYS, generation_id, created_at and what ``decide`` asks for; those of a key come in the order of
    created_at and generation_id.  heads: KEYS, generation_id, previous_id, revision and COMPARED.  A promotion
    raises the revision by one; of a key's generations the active one and the one before it are kept (previous_id).
    Decisions name the champion that a candidate met (champion_id) and the revision after it.
    """
    c = admission(candidates).select(*KEYS, "created_at", "generation_id", *COMPARED, "expected_version", "admission_reason")
    kinds = dict(c.dtypes)
    fields = ", ".join(f"{x}: {kinds[x]}" for x in COMPARED)
    memory = f"struct<generation_id: {kinds['generation_id']}, previous_id: {kinds['generation_id']}, revision: bigint, {fields}>"
    names = ["generation_id", "previous_id", "revision", *COMPARED]
    empty = F.struct(*[F.lit(0).cast("bigint").alias(x) if x == "revision" else F.lit(None).cast(kinds["generation_id" if x == "previous_id" else x]).alias(x) for x in names])

    def step(m: Column, row: Column) -> Column:
        def judged(x: Column) -> Column:
            m, row, reason = x["m"], x["row"], x["reason"]
            after = F.struct(row["generation_id"].alias("generation_id"), m["generation_id"].alias("previous_id"), (m["revision"] + 1).alias("revision"), *[row[k].alias(k) for k in COMPARED])
            made = F.struct(row["created_at"].alias("created_at"), row["generation_id"].alias("generation_id"), reason.startswith("promoted").alias("promote"), reason.alias("reason"), m["generation_id"].alias("champion_id"), F.when(reason.startswith("promoted"), m["revision"] + 1).otherwise(m["revision"]).alias("revision"))
            return F.struct(F.when(reason.startswith("promoted"), after).otherwise(m).alias("memory"), made.alias("made"))

        return let(F.struct(m.alias("m"), row.alias("row"), _reason(lambda k: row[k], lambda k: m[k], least).alias("reason")), judged)

    start = None if heads is None else heads.select(*KEYS, F.struct(*[F.col(x).cast("bigint" if x == "revision" else kinds["generation_id" if x == "previous_id" else x]).alias(x) for x in names]).cast(memory).alias("memory"))
    made = f"struct<created_at: {kinds['created_at']}, generation_id: {kinds['generation_id']}, promote: boolean, reason: string, champion_id: {kinds['generation_id']}, revision: bigint>"
    decisions, final = fold(c, list(KEYS), ["created_at", "generation_id"], start, empty.cast(memory), step, made)
    return decisions, final.select(*KEYS, "memory.*").where("generation_id is not null")


def apply_promotions(heads: DataFrame, decided: DataFrame) -> DataFrame:
    """Heads after the promotions: revision + 1 where the head still is the expected
    generation, unchanged elsewhere.  heads: KEYS, generation_id, revision; decided: KEYS,
    promote, generation_id, expected_generation.  A key has one promoted candidate at most; a second
    one fails the job, as only ``promote`` can tell which of them meets the other."""
    new = decided.where("promote").withColumn("_n", F.count("*").over(Window.partitionBy(*KEYS)))
    new = new.where(F.when(F.col("_n") > 1, F.raise_error("a key has two promoted candidates").cast("boolean")).otherwise(True)).select(*KEYS, F.col("generation_id").alias("new_id"), "expected_generation")
    return swapped(heads, new)


def swapped(heads: DataFrame, new: DataFrame) -> DataFrame:
    """Heads after the compare-and-set, a row for each pair of a head and a promoted candidate of its key.  heads: KEYS,
    generation_id, revision; new: KEYS, new_id, expected_generation.  Nothing says which of several candidates comes first."""
    both = heads.join(new, list(KEYS), "full_outer")
    swap = F.col("new_id").isNotNull() & F.col("expected_generation").eqNullSafe(F.col("generation_id"))
    return both.select(*KEYS, F.when(swap, F.col("new_id")).otherwise(F.col("generation_id")).alias("generation_id"), F.when(swap, F.coalesce("revision", F.lit(0)) + 1).otherwise(F.col("revision")).cast("long").alias("revision")).where("generation_id is not null")


def _latest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*order))).where(F.col("_k") <= n).drop("_k")


def retained(generations: DataFrame, heads: DataFrame) -> DataFrame:
    """The active generation and the latest one before it, of every key."""
    active = heads.select(*KEYS, F.col("generation_id").alias("active"))
    df = generations.join(active, list(KEYS), "left")
    return _latest(df, KEPT_GENERATIONS, F.coalesce(F.col("generation_id") == F.col("active"), F.lit(False)).desc(), F.col("created_at").desc(), F.col("generation_id")).drop("active")


def fingerprint(df: DataFrame, columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON of an attempt: fields in a fixed order, nulls written."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def rejections(decided: DataFrame, ledger: DataFrame) -> DataFrame:
    """The ledger with the newly rejected attempts, each once, the last 64 of every key."""
    new = decided.where("not promote").select(*KEYS, "attempt_fingerprint", "reason", "created_at")
    both = ledger.select(new.columns).unionByName(new.join(ledger, [*KEYS, "attempt_fingerprint"], "left_anti"))
    once = both.groupBy(*KEYS, "attempt_fingerprint").agg(F.min_by("reason", "created_at").alias("reason"), F.min("created_at").alias("created_at"))
    return _latest(once, KEPT_REJECTIONS, F.col("created_at").desc(), F.col("attempt_fingerprint"))


def load(requests: DataFrame, heads: DataFrame, generations: DataFrame) -> DataFrame:
    """Every request with its model and load_reason (null: usable): compatibility in a fixed
    order, then the checksum of the model's bytes."""
    g = generations.select(*KEYS, "generation_id", "model", "model_checksum", *[F.col(c).alias("own_" + c) for c in COMPATIBLE])
    df = requests.join(heads.select(*KEYS, "generation_id"), list(KEYS), "left").join(g, [*KEYS, "generation_id"], "left")
    reason = F.when(F.col("model_checksum").isNull(), "model_not_found")
    for c in COMPATIBLE:
        reason = reason.when(~F.col(c).eqNullSafe(F.col("own_" + c)), f"incompatible_{c}")
    reason = reason.when(F.sha2("model", 256) != F.col("model_checksum"), "corrupt_model")
    return df.withColumn("load_reason", reason).drop(*["own_" + c for c in COMPATIBLE])


def violations(generations: DataFrame) -> DataFrame:
    """Rows that break the constraints of the table, with the constraint's name."""
    c = F.col
    bad = (
        F.when(~c("target").isin("wind_speed", "ambient_temp"), "target").when(~c("status").isin("active", "history", "staged"), "status")
        .when(~c("model_checksum").rlike("^[0-9a-f]{64}$"), "checksum").when(c("revision") <= 0, "revision")
        .when(F.get_json_object("metadata", "$.tower_id") != c("tower_id"), "metadata")
    )
    return generations.withColumn("violation", bad).where("violation is not null")

"""Repository setups: providers, desired configuration, drift, outcome and gate state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline import fixed_values as fv
from plumbline.functions.text import trim_end


def provider_dim(spark: SparkSession) -> DataFrame:
    """Three fixed rows."""
    return spark.createDataFrame(
        fv.PROVIDERS,
        "provider string, label string, mechanism string, link string, instructions array<string>",
    )


def with_provider(setups: DataFrame, providers: DataFrame, check_name: str = fv.CHECK_NAME) -> DataFrame:
    """Descriptor of each setup's provider; one that the table lacks falls back to the default one."""
    known = providers.select(F.col("provider").alias("gate_provider"), F.col("provider").alias("__known")).distinct()
    resolved = F.coalesce("__known", F.lit(fv.DEFAULT_PROVIDER))
    joined = setups.join(known, "gate_provider", "left").withColumn("provider", resolved).drop("__known").join(providers, "provider")
    branch = F.when(F.coalesce("default_branch", F.lit("")) != "", F.col("default_branch")).otherwise(fv.NO_BRANCH_TEXT)
    fill = lambda text: F.replace(
        F.replace(text, F.lit("{branch}"), branch), F.lit("{check}"), F.lit(check_name)
    )
    return joined.withColumns(
        {
            "settings_url": F.replace("link", F.lit("{repo}"), F.col("repo_full_name")),
            "instructions": F.transform("instructions", fill),
        }
    ).drop("link")


def desired_config(mechanism: Column, branch: Column, dispatch_text: str, branch_text: str) -> Column:
    """Configuration text of a mechanism; ``{branch}`` in the branch form defaults to ``main``."""
    name = F.when(F.coalesce(branch, F.lit("")) != "", branch).otherwise("main")
    filled = F.replace(F.lit(branch_text), F.lit("{branch}"), name)
    return F.when(mechanism == "deployment-dispatch", dispatch_text).otherwise(filled)


def workflow_texts(
    action_ref: str, secret_name: str, tool: str = fv.TOOL_NAME, check_name: str = fv.CHECK_NAME
) -> tuple[str, str]:
    """The two workflow files for ``desired_config``: after a deployment, and on branch checks."""
    values = {"{tool}": tool, "{check}": check_name, "{action}": action_ref, "{secret}": secret_name}
    texts = []
    for text in (fv.WORKFLOW_DISPATCH, fv.WORKFLOW_BRANCH):
        for mark, value in values.items():
            text = text.replace(mark, value)
        texts.append(text)
    return texts[0], texts[1]


def config_drift(observed: DataFrame, desired: DataFrame, overwrite: bool = False) -> DataFrame:
    """``state`` of each desired file: created, unchanged (trailing space aside), updated or drift."""
    joined = desired.select("repo_full_name", "desired").join(
        observed.select("repo_full_name", "content"), "repo_full_name", "left"
    )
    same = trim_end(F.col("content")) == trim_end(F.col("desired"))
    state = (
        F.when(F.col("content").isNull(), "created").when(same, "unchanged")
        .otherwise("updated" if overwrite else "drift")
    )
    return joined.select("repo_full_name", state.alias("state"))


def setup_outcome(runs: DataFrame) -> DataFrame:
    """States after a run: a failure turns a pending workflow and an unset secret into errors."""
    failed = F.col("error").isNotNull()
    return runs.withColumns(
        {
            "workflow_state": F.when(failed & (F.col("workflow_state") == "pending"), "error")
            .otherwise(F.col("workflow_state")),
            "secret_state": F.when(failed & (F.col("secret_state") != "set"), "error").otherwise(F.col("secret_state")),
            "last_error": F.col("error"),
        }
    ).drop("error")


SETUP_FIELDS = [
    "installation_id", "default_branch", "workflow_state", "secret_state", "api_key_id", "gate_provider", "last_error",
]


def apply_setup_events(setups: DataFrame, runs: DataFrame, attestations: DataFrame | None = None) -> DataFrame:
    """Upsert runs on (user, repo), then attestations.

    The last run overwrites all fields. A change of provider resets the gate to unverified and clears its
    check time; the same provider keeps both. Runs are in ``seq`` order and carry the changes between them,
    so it is enough to know the last run and whether any step changed the provider.
    """
    keys = ["user_id", "repo_full_name"]
    row = F.struct("seq", *SETUP_FIELDS)
    folded = setup_outcome(runs).groupBy(*keys).agg(
        F.max_by(row, "seq").alias("r"), F.min_by("gate_provider", "seq").alias("first_provider"),
        F.min("gate_provider").alias("low"), F.max("gate_provider").alias("high"),
    )
    joined = setups.join(folded, keys, "full")
    ran, existed = F.col("r").isNotNull(), F.col("gate_state").isNotNull()
    changed = existed & ((F.col("first_provider") != F.col("gate_provider")) | (F.col("low") != F.col("high")))
    reset = ran & (~existed | changed)
    pick = lambda c: F.when(ran, F.col(f"r.{c}")).otherwise(F.col(c)).alias(c)
    state = joined.select(
        *keys, *[pick(c) for c in SETUP_FIELDS],
        F.when(reset, "unverified").otherwise(F.col("gate_state")).alias("gate_state"),
        F.when(~reset, F.col("gate_last_checked_at")).alias("gate_last_checked_at"),
    )
    return state if attestations is None else attest(state, attestations)


def attest(setups: DataFrame, attestations: DataFrame) -> DataFrame:
    """The user states that the check is required: state and check time are set."""
    keys = ["user_id", "repo_full_name"]
    last = attestations.groupBy(*keys).agg(F.max("ts").alias("__at"))
    done = F.col("__at").isNotNull()
    return (
        setups.join(last, keys, "left")
        .withColumn("gate_state", F.when(done, "required").otherwise(F.col("gate_state")))
        .withColumn("gate_last_checked_at", F.coalesce("__at", "gate_last_checked_at"))
        .drop("__at")
    )


def due_for_recheck(setups: DataFrame, connections: DataFrame, as_of: str) -> DataFrame:
    """Default-provider setups of connected users that are not required and were not checked lately."""
    now = F.lit(as_of).cast("timestamp_ntz")
    late = F.col("gate_last_checked_at") <= now - F.expr(f"INTERVAL {fv.GATE_RECHECK_SECONDS} SECONDS")
    return setups.filter(
        (F.col("gate_provider") == fv.DEFAULT_PROVIDER) & (F.col("gate_state") != "required")
        & F.coalesce(late, F.lit(True))
    ).join(connections.select("user_id"), "user_id", "left_semi")


def apply_recheck(setups: DataFrame, results: DataFrame) -> DataFrame:
    """Checks only upgrade to required; otherwise just the check time moves."""
    keys = ["user_id", "repo_full_name"]
    seen = results.groupBy(*keys).agg(
        F.bool_or(F.col("state") == "required").alias("__up"), F.max("ts").alias("__at")
    )
    return (
        setups.join(seen, keys, "left")
        .withColumn("gate_state", F.when(F.col("__up"), "required").otherwise(F.col("gate_state")))
        .withColumn("gate_last_checked_at", F.coalesce("__at", "gate_last_checked_at"))
        .drop("__up", "__at")
    )

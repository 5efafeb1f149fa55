"""Tenant onboarding: plans, duplicate emails, tenant ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators import ordering

# Plans a tenant can ask for.
PLANS = ["founder", "creator", "label", "enterprise"]


def tenant_uid(applications: DataFrame, clients: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted with tenant_id, rejected with reason).

    The first application of an email with a known plan wins.  Emails whose id
    collides get a numbered suffix by application order.
    """
    known = clients.select("email").distinct().withColumn("known", F.lit(True))
    valid_plan = F.col("plan").isin(PLANS)
    first = (
        applications.where(valid_plan)
        .groupBy("email")
        .agg(F.min("application_id").alias("first_application"))
    )
    judged = (
        applications.join(known, "email", "left")
        .join(first, "email", "left")
        .withColumn(
            "reason",
            F.when(F.col("known") | (F.col("application_id") > F.col("first_application")), F.lit("email_known"))
            .when(~valid_plan, F.lit("plan_unknown")),
        )
        .drop("known", "first_application")
    )
    slug = F.concat(F.lit("tn_"), F.upper(F.substring(F.md5(F.lower("email")), 1, 8)))
    accepted = ordering.with_position(
        judged.where("reason is null").withColumn("slug", slug),
        ["slug"],
        F.floor(F.col("application_id") / 65536),
        [F.col("application_id")],
        "nth",
    )
    ok = accepted.withColumn(
        "tenant_id",
        F.when(F.col("nth") == 1, F.col("slug")).otherwise(
            F.concat_ws("_", "slug", F.lpad((F.col("nth") - 1).cast("string"), 4, "0"))
        ),
    ).drop("slug", "nth", "reason")
    return ok, judged.where("reason is not null")

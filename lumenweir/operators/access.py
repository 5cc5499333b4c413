"""Roles and attribute policies as joins, and lifecycle transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which lifecycle states follow which.
TRANSITIONS = {"draft": ["review", "archived"], "review": ["published", "draft"], "published": ["archived", "review"], "archived": ["draft"]}


def condition(value: Column, op: str, expected) -> Column:
    """One condition of a policy on an attribute; a missing attribute meets none but a negative one."""
    ops = {
        "eq": lambda: value == expected, "neq": lambda: value.isNull() | (value != expected), "in": lambda: value.isin(*expected), "not_in": lambda: value.isNull() | ~value.isin(*expected),
        "contains": lambda: value.contains(expected), "starts_with": lambda: value.startswith(expected), "between": lambda: value.between(*expected), "exists": lambda: value.isNotNull() if expected else value.isNull(), "regex": lambda: value.rlike(f"^(?:{expected})"),
    }
    return F.coalesce(ops[op](), F.lit(False))


def evaluated(requests: DataFrame, policies: list[dict]) -> DataFrame:
    """With effect: that of the first active policy whose resource, action (or `*`) and conditions all match; deny without one."""
    out = None
    for p in policies:
        if not p.get("active", True):
            continue
        match = F.lit(True)
        for k in ("resource", "action"):
            match = match & (F.lit(p[k] == "*") | (F.col(k) == p[k]))
        for attribute, op, expected in p.get("conditions", ()):
            match = match & condition(F.col(attribute), op, expected)
        out = F.when(match, p["effect"]) if out is None else out.when(match, p["effect"])
    return requests.withColumn("effect", F.lit("deny") if out is None else out.otherwise("deny"))


def permitted(requests: DataFrame, user_roles: DataFrame, grants: DataFrame) -> DataFrame:
    """With allowed, for requests (request, user, resource, action, scope): whether a role of the user, global (scope null)
    or of that scope, has a grant (role, permission) of `*:*`, `resource:*` or `resource:action`."""
    wanted = requests.withColumn("permission", F.explode(F.array(F.lit("*:*"), F.concat("resource", F.lit(":*")), F.concat_ws(":", "resource", "action"))))
    roles = user_roles.select("user", "role", F.col("scope").alias("role_scope"))
    having = wanted.join(roles, "user").where(F.col("role_scope").isNull() | (F.col("role_scope") == F.col("scope")))
    ok = having.join(grants, ["role", "permission"], "left_semi").select("request").distinct().withColumn("allowed", F.lit(True))
    return requests.join(ok, "request", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def valid_transition(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for state, follow in TRANSITIONS.items():
        out = out | ((before == state) & after.isin(*follow))
    return out

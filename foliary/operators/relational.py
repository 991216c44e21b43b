"""Scoped tables: tenants, soft delete, versions, recycle bin, merges and roll-ups as pure DataFrame functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scoped(df: DataFrame, include_deleted: bool = False, **scope) -> DataFrame:
    """Rows of a scope; every scope value must be given. Deleted rows (deleted_at set) only on request."""
    if any(v is None for v in scope.values()):
        raise ValueError("a scope value is missing")
    live = [] if include_deleted or "deleted_at" not in df.columns else [F.col("deleted_at").isNull()]
    return df.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in scope.items()] + live, F.lit(True)))


def visible(df: DataFrame, column: str, value) -> DataFrame:
    """Own and shared rows; without a value shared rows only."""
    return df.where(F.col(column).isNull() if value is None else (F.col(column) == F.lit(value)) | F.col(column).isNull())


def matching(df: DataFrame, contains: dict[str, str | None], equals: dict[str, tuple[str | None, set[str]]]) -> DataFrame:
    """Optional filters: LIKE without case, and equality that is ignored for values not allowed."""
    for k, v in contains.items():
        df = df.where(F.col(k).ilike(f"%{v}%")) if v else df
    for k, (v, allowed) in equals.items():
        df = df.where(F.col(k) == v) if v in allowed else df
    return df


def setting(kv: DataFrame, scope: str, tenant: str | None, key: str) -> DataFrame:
    if (scope == "system") != (tenant is None):
        raise ValueError("a system setting has no tenant, any other has one")
    return kv.where((F.col("scope") == scope) & F.col("tenant").eqNullSafe(F.lit(tenant)) & (F.col("key") == key))


def expired(bin_rows: DataFrame, as_of: Column) -> DataFrame:
    return bin_rows.where((F.col("purge_at") <= as_of) & ~F.col("status").isin("restoring", "conflict"))


def soft_delete(df: DataFrame, chosen: Column, as_of: Column) -> DataFrame:
    return df.withColumn("deleted_at", F.when(chosen & F.col("deleted_at").isNull(), as_of).otherwise(F.col("deleted_at")))


def restore(df: DataFrame, chosen: Column) -> DataFrame:
    return df.withColumn("deleted_at", F.when(~chosen, F.col("deleted_at")))


def latest(df: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """The last row of each key; partial aggregation, so a hot key isn't sorted in one task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r")).select(*keys, "r.*")


def deprecated(df: DataFrame, key: str, version: str) -> DataFrame:
    """Each row with a status: active in the last version of its key, else deprecated."""
    last = F.max(version).over(Window.partitionBy(key))
    return df.withColumn("status", F.when(F.col(version) == last, "active").otherwise("deprecated"))


def first_wins(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def overridden(base: DataFrame, user: DataFrame, key: str, value: str, removed: str) -> DataFrame:
    """Baseline rows under user rows: the user's value wins, removed rows go, added rows come."""
    b, u = base.select(key, F.col(value).alias("base")), user.select(key, F.col(value).alias("own"), F.col(removed).alias("gone"))
    return b.join(u, key, "full_outer").where(~F.coalesce("gone", F.lit(False))).select(key, F.coalesce("own", "base").alias(value), F.when(F.col("base").isNull(), "added").when(F.col("own").isNull(), "baseline").otherwise("changed").alias("origin"))


def unresolved(required: DataFrame, confirmed: DataFrame, on: str) -> DataFrame:
    return required.join(confirmed, on, "left_anti")


def array_change(new: str, old: str) -> list[Column]:
    return [F.array_sort(F.array_except(new, old)).alias("added"), F.array_sort(F.array_except(old, new)).alias("removed")]


def roll_up(items: DataFrame, key: str, state: str = "state") -> DataFrame:
    """Job state of each key: running, then success of all, then any error, else idle; with a count of each state."""
    n = lambda s: F.count_if(F.col(state) == s)
    job = F.when(n("running") > 0, "running").when(n("success") == F.count("*"), "success").when(n("error") > 0, "error").otherwise("idle")
    return items.groupBy(key).agg(job.alias("job_state"), *[n(s).alias(f"n_{s}") for s in ("running", "success", "error", "idle")])


def cumulative_start(df: DataFrame, key: str, order: list[str], size: str) -> DataFrame:
    """1 + the sum of earlier sizes: the page on which each part starts."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("starts_at", 1 + F.coalesce(F.sum(size).over(w), F.lit(0)))


def one(df: DataFrame, **scope) -> DataFrame:
    """The single row of a scope; none, a deleted one and one of another scope are all the same error."""
    rows = scoped(df, **scope)
    if len(rows.limit(2).collect()) != 1:
        raise LookupError("not found")
    return rows


def strays(df: DataFrame, **scope) -> DataFrame:
    """Rows that a write into a scope must not hold: another scope value, or none."""
    return df.where(reduce(lambda a, b: a | b, [~F.col(k).eqNullSafe(F.lit(v)) for k, v in scope.items()], F.lit(False)))


def missing(registered: DataFrame, present: DataFrame, on: str) -> DataFrame:
    """Registered rows that aren't there; ``all_present`` raises if there is any."""
    return registered.join(present.select(on).distinct(), on, "left_anti")


def all_present(registered: DataFrame, present: DataFrame, on: str) -> DataFrame:
    gone = [r[on] for r in missing(registered, present, on).select(on).limit(5).collect()]
    if gone:
        raise FileNotFoundError(f"registered but missing: {gone}")
    return registered.join(present.select(on).distinct(), on, "left_semi")


def first_source(key: str, *sources: DataFrame) -> DataFrame:
    """Rows of the first source that has their key (key, path)."""
    rows = reduce(DataFrame.unionByName, [s.select(key, "path", F.lit(k).alias("source")) for k, s in enumerate(sources)])
    return rows.groupBy(key).agg(F.min_by(F.struct("path", "source"), F.struct("source", "path")).alias("r")).select(key, "r.*")


def latest_round(items: DataFrame, key: str, pending: bool = False) -> DataFrame:
    """Items of each key's last round (round 1 where none is named); only pending ones on request."""
    last = items.groupBy(key).agg(F.coalesce(F.max("round"), F.lit(1)).alias("last"))
    rows = items.join(last, key).where(F.coalesce("round", F.lit(1)) == F.col("last")).drop("last")
    return rows.where("status = 'pending'") if pending else rows


def next_round(items: DataFrame, key: str, reset_status: bool = False) -> DataFrame:
    """A new round of each key: its last round's items once more, with their status or all pending."""
    rows = latest_round(items, key).withColumn("round", F.coalesce("round", F.lit(1)) + 1)
    return rows.withColumn("status", F.lit("pending")) if reset_status else rows


def regenerated(items: DataFrame, fresh: DataFrame, key: str, as_of: Column) -> DataFrame:
    """Rounds made anew: live items of keys that ``fresh`` has are deleted as of now, and the fresh ones come."""
    again = fresh.select(key).distinct().withColumn("again", F.lit(True))
    old = items.join(again, key, "left").withColumn("deleted_at", F.when(F.col("again") & F.col("deleted_at").isNull(), as_of).otherwise(F.col("deleted_at"))).drop("again")
    return old.unionByName(fresh.withColumn("deleted_at", F.lit(None).cast("timestamp")))


def round_gate(items: DataFrame, key: str) -> DataFrame:
    """Whether each key's items can be confirmed: there are some and none is pending."""
    return items.groupBy(key).agg(F.count("*").alias("items"), F.count_if(F.col("status") == "pending").alias("pending")).withColumn("ok", (F.col("items") > 0) & (F.col("pending") == 0))


def bin_rows(rows: DataFrame, tenant: str | None, kind: str | None = None) -> DataFrame:
    """A tenant's recycle bin, of one kind on request; without a tenant only tenants themselves."""
    rows = rows.where(F.col("item_type") == "enterprise") if tenant is None else rows.where(F.col("tenant") == tenant)
    return rows if kind is None or tenant is None else rows.where(F.col("item_type") == kind)


def restored(rows: DataFrame, target: DataFrame, parents: DataFrame) -> DataFrame:
    """Bin rows (ref_id, parent) with what restoring them does: restored, or why it can't be.

    target: (ref_id, deleted_at) of the items; parents: (parent) of those that are live.
    """
    live = parents.select("parent").distinct().withColumn("parent_live", F.lit(True))
    met = rows.join(target.select("ref_id", F.col("deleted_at").isNotNull().alias("gone")), "ref_id", "left").join(live, "parent", "left")
    outcome = F.when(F.col("gone").isNull(), "absent").when(~F.col("gone"), "not deleted").when(F.col("parent_live").isNull(), "parent deleted").otherwise("restored")
    return met.select("ref_id", outcome.alias("outcome"))


def purged(rows: DataFrame, bin_items: DataFrame, as_of: Column, failed: DataFrame | None = None, tries: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, bin after the sweep): expired items are removed with their bin rows; those whose files could not be
    deleted in ``tries`` attempts (failed: ref_id, attempts) stay, marked as conflict."""
    due = expired(bin_items, as_of).select("ref_id").distinct()
    stuck = failed.where(F.col("attempts") >= tries).select("ref_id").distinct() if failed is not None else due.limit(0)
    gone = due.join(stuck, "ref_id", "left_anti")
    held = bin_items.join(gone, "ref_id", "left_anti").join(due.join(stuck, "ref_id", "left_semi").withColumn("stuck", F.lit(True)), "ref_id", "left")
    return rows.join(gone, "ref_id", "left_anti"), held.withColumn("status", F.when(F.col("stuck"), "conflict").otherwise(F.col("status"))).drop("stuck")


def deletable(parents: DataFrame, children: DataFrame, on: str) -> DataFrame:
    """Each parent with whether it can be deleted: no live child."""
    live = children.where(F.col("deleted_at").isNull()).select(on).distinct().withColumn("busy", F.lit(True))
    return parents.join(live, on, "left").withColumn("deletable", F.col("busy").isNull()).drop("busy")


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that ``new`` has are replaced by its own; other keys stay."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def resolved(findings: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """findings with the status that answers (key, action) give them: accepted or rejected, else as they were."""
    rows = findings.join(answers.select(key, "action"), key, "left")
    return rows.withColumn("status", F.when(F.col("action") == "accept", "accepted").when(F.col("action") == "reject", "rejected").otherwise(F.col("status"))).drop("action")


def edited_list(base: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """base (key, title) after edits (key, op, title, at): of each key the last edit counts; add and update set the title,
    remove takes the row, reset brings the base row back."""
    last = edits.groupBy(key).agg(F.max_by(F.struct("op", F.col("title").alias("new")), "at").alias("e"))
    rows = base.join(last, key, "full_outer")
    title = F.when(F.col("e.op").isin("add", "update"), F.col("e.new")).otherwise(F.col("title"))
    return rows.select(key, title.alias("title"), F.coalesce("e.op", F.lit("base")).alias("op")).where("op <> 'remove' and title is not null")


def merged_words(old: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """A dictionary (category, value) after words were added and removed; each once."""
    return old.unionByName(added).distinct().join(removed, ["category", "value"], "left_anti")


def bumped(rows: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """rows (key, name, version) with changed names (key, name): the version of a changed row is one more."""
    met = rows.join(changed.select(key, F.col("name").alias("new")), key, "left")
    new = F.col("new").isNotNull() & (F.col("new") != F.col("name"))
    return met.select(key, F.when(new, F.col("new")).otherwise(F.col("name")).alias("name"), (F.col("version") + new.cast("int")).alias("version"))


def merged_meta(old: Column, new: Column) -> Column:
    """map of metadata: new values that aren't null or empty win over old ones."""
    return F.map_filter(F.map_zip_with(old, new, lambda _, a, b: F.when(b.isNotNull() & (b != ""), b).otherwise(a)), lambda _, v: v.isNotNull())

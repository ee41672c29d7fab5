"""Changes of the registries and the log as committed versions (H06, H07): activation, deletion and its cascade.

The relation: a user owns datasets, models and predictions; a dataset has models
and predictions; a model has predictions. Deleting a row deletes everything below
it. Each function reads one snapshot, plans the changed tables with joins, and
commits them together; readers of older versions are not affected.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from retainx.operators.history import activate
from retainx.sources.snapshots import Snapshot, SnapshotStore


@dataclass(frozen=True)
class Link:
    """Rows of ``child`` belong to the row of ``parent`` whose id is in their column ``key``."""

    child: str
    key: str
    parent: str


#: Rows without a parent are dealt to so many shares of a join: their key alone would send them all to one task.
SHARES = 1000

RELATION = (
    Link("datasets", "user_id", "users"), Link("models", "user_id", "users"), Link("predictions", "user_id", "users"),
    Link("models", "dataset_id", "datasets"), Link("predictions", "dataset_id", "datasets"), Link("predictions", "model_id", "models"),
)


def parents_first(links: tuple[Link, ...]) -> list[str]:
    """Table names in an order that puts parents before children; a circle is an error."""
    names = list(dict.fromkeys(n for link in links for n in (link.parent, link.child)))
    out: list[str] = []
    while len(out) < len(names):
        free = [n for n in names if n not in out and all(link.parent in out for link in links if link.child == n)]
        if not free:
            raise ValueError("the links form a circle: " + ", ".join(n for n in names if n not in out))
        out += free
    return out


def _without(table: DataFrame, which: DataFrame, column: str, key: str) -> DataFrame:
    """The rows whose ``column`` is not in ``which`` or null; nulls match nothing and are spread over the tasks."""
    share = F.when(F.col(column).isNull(), F.pmod(F.xxhash64(key), F.lit(SHARES))).otherwise(F.lit(0).cast("bigint"))
    zero = F.pmod(F.xxhash64(column), F.lit(1)).cast("bigint")         # a literal would not be kept as a key of the join
    return table.withColumn("_share", share).join(which.withColumn("_share", zero), [column, "_share"], "left_anti").drop("_share")


def cascade(tables: dict[str, DataFrame], roots: dict[str, DataFrame], links: tuple[Link, ...] = RELATION,
            key: str = "id") -> dict[str, DataFrame]:
    """What is left of every table that can lose rows when the ``roots`` (frames with an id column) go.

    One walk down the relation: a table loses the rows whose id is named and, for
    each link, those whose parent goes. Only ids travel, each level's to the next,
    and a link is one anti join; a row without a parent (null key) stays, and so
    does one whose parent is missing anyway. Tables not in ``tables`` are skipped,
    with what lies below them.
    """
    unknown = set(roots) - set(tables)
    if unknown:
        raise ValueError("no such table: " + ", ".join(sorted(unknown)))
    order = [n for n in dict.fromkeys([*parents_first(links), *roots]) if n in tables]
    gone: dict[str, DataFrame] = {}
    left: dict[str, DataFrame] = {}
    for name in order:
        table, doomed = tables[name], []
        if name in roots:
            doomed.append((key, roots[name].select(key).where(F.col(key).isNotNull()).distinct()))
        doomed += [(link.key, gone[link.parent].withColumnRenamed(key, link.key)) for link in links if link.child == name and link.parent in gone]
        if not doomed:
            continue
        kept, ids = table, []
        for column, which in doomed:
            kept = _without(kept, which, column, key)
            ids.append(table.join(which, column, "left_semi").select(key))
        left[name] = kept.select(*table.columns)
        if any(link.parent == name for link in links):
            every = ids[0]
            for more in ids[1:]:
                every = every.unionByName(more)
            gone[name] = every.where(F.col(key).isNotNull()).distinct()
    return left


def delete(store: SnapshotStore, roots: dict[str, DataFrame], base: Snapshot | None = None, links: tuple[Link, ...] = RELATION) -> Snapshot:
    """Commit the version without the ``roots`` and everything that belongs to them."""
    base = base or store.snapshot()
    return store.commit(cascade(store.tables(base), roots, links), base)


def delete_dataset(store: SnapshotStore, user_id: int, dataset_id: int, base: Snapshot | None = None) -> Snapshot:
    """A user's dataset with its models and their predictions; someone else's, or none, is an error."""
    base = base or store.snapshot()
    own = store.table("datasets", base).where((F.col("user_id") == user_id) & (F.col("id") == dataset_id)).select("id")
    if own.isEmpty():
        raise ValueError(f"user {user_id} has no dataset {dataset_id}")
    return delete(store, {"datasets": own}, base)


def clear_history(store: SnapshotStore, user_id: int, base: Snapshot | None = None) -> Snapshot:
    """All of a user's predictions; rows without a user stay."""
    base = base or store.snapshot()
    log = store.table("predictions", base)
    return store.commit({"predictions": log.where(~F.col("user_id").eqNullSafe(F.lit(user_id)))}, base)


def set_active(store: SnapshotStore, table: str, chosen: DataFrame, base: Snapshot | None = None) -> Snapshot:
    """Commit the registry with exactly the chosen row (user_id, id) of each named user active.

    Users that ``chosen`` doesn't name keep their flags. A choice that is not a row
    of its user, or two for one user, is an error.
    """
    base = base or store.snapshot()
    registry = store.table(table, base)
    picks = chosen.select("user_id", "id").distinct()
    wrong = picks.groupBy("user_id").count().where("count > 1").select("user_id") \
        .unionByName(picks.join(registry, ["user_id", "id"], "left_anti").select("user_id"))
    if not wrong.isEmpty():
        raise ValueError("a chosen row is not its user's, or not the only one")
    named = registry.join(picks.select("user_id"), "user_id", "left_semi")
    others = registry.join(picks.select("user_id"), "user_id", "left_anti")
    return store.commit({table: activate(named, picks).select(*registry.columns).unionByName(others)}, base)


def add_dataset(store: SnapshotStore, added: DataFrame, base: Snapshot | None = None) -> Snapshot:
    """H06 on upload: the new rows (one for each user) are registered and active, the users' others no longer."""
    base = base or store.snapshot()
    registry = store.table("datasets", base)
    old = registry.join(added.select("user_id").distinct().withColumn("_new", F.lit(True)), "user_id", "left") \
        .withColumn("is_active", F.col("is_active") & F.col("_new").isNull()).select(*registry.columns)
    return store.commit({"datasets": old.unionByName(added.withColumn("is_active", F.lit(True)).select(*registry.columns))}, base)

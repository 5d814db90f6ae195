"""Product lifecycle: compare a snapshot with an archive and a master table. Keys are a parameter; null keys never match and drop out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions import text as T
from shelfwise.operators.dedupe import first_by

STATE = ["status", "first_seen_date", "last_seen_date", "last_updated"]


def first_rows(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row for each key without nulls: the first by `order`; the least by all its columns, so always the same one, without an order."""
    known = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    if order is not None:
        return first_by(known, keys, order).drop(order)
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return known.select(*keys).distinct()
    row = F.struct(*[f"`{c}`" for c in rest])
    plain = not any(kind in known.select(row).schema.simpleString() for kind in ("map<", "variant"))
    least = F.min(row) if plain else F.min_by(row, F.to_json(row))
    return known.groupBy(*keys).agg(least.alias("__row")).select(*[F.col(c) if c in keys else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def align_sides(sides: dict[str, DataFrame], keys: list[str], order: str = "ord") -> DataFrame:
    """keys and, for each side, the struct of its first row (null where it lacks the key); `order` counts where a side has it.

    The sides are stacked and grouped once, so each row is shuffled once and no join follows; first rows combine before the shuffle. Rows whose order is
    null come last, rows with a null key drop out.
    """
    stacked = []
    for name, df in sides.items():
        known = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
        rest = [F.col(f"`{x}`") for x in df.columns if x not in keys and x != order]
        row = F.struct(*keys, *rest)
        if order in df.columns:
            place = F.struct(F.col(order).isNull(), F.col(order))
        else:
            plain = not any(kind in df.schema.simpleString() for kind in ("map<", "variant"))
            place = F.struct(F.lit(False), F.struct(*rest) if plain and rest else F.to_json(row))
        stacked.append(known.select(*keys, place.alias(f"__at_{name}"), row.alias(name)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stacked)
    return rows.groupBy(*keys).agg(*[F.min_by(name, f"__at_{name}").alias(name) for name in sides])


def _present(aligned: DataFrame, keys: list[str]) -> DataFrame:
    return aligned.select(*keys, *[F.col(n).isNotNull().alias(f) for n, f in (("cur", "in_current"), ("arc", "in_archive"), ("mas", "in_master"))], "cur", "arc", "mas")


def lifecycle_join(current: DataFrame, archive: DataFrame, master: DataFrame, keys: list[str], order: str = "ord", buckets: int | None = None) -> DataFrame:
    """keys, in_current, in_archive, in_master and the first row of each side as structs cur, arc, mas; `order` counts where a side has it.

    With `buckets` the master is a table in that many buckets of the keys, one row a key (store.read_bucketed): it is joined where it lies, and only
    the rows of the snapshots are shuffled, to the same buckets.
    """
    if buckets is None:
        return _present(align_sides({"cur": current, "arc": archive, "mas": master}, keys, order), keys)
    day = align_sides({"cur": current, "arc": archive}, keys, order).repartition(buckets, *keys)
    return _present(day.join(master.select(*keys, F.struct(*[f"`{x}`" for x in master.columns]).alias("mas")), keys, "full"), keys)


def known_names(current: DataFrame, master: DataFrame, keys: list[str]) -> DataFrame:
    return current.select(*keys).distinct().join(master.select(*keys), keys, "left_semi")


def new_names(current: DataFrame, master: DataFrame, keys: list[str]) -> DataFrame:
    return current.select(*keys).distinct().join(master.select(*keys), keys, "left_anti")


def archived_missing(archive: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    return archive.select(*keys).distinct().join(current.select(*keys), keys, "left_anti")


def master_missing(master: DataFrame, current: DataFrame, archive: DataFrame, keys: list[str]) -> DataFrame:
    return master.select(*keys).distinct().join(current.select(*keys), keys, "left_anti").join(archive.select(*keys), keys, "left_anti")


def all_names(current: DataFrame, archive: DataFrame, master: DataFrame, keys: list[str]) -> DataFrame:
    return current.select(*keys).union(archive.select(*keys)).union(master.select(*keys)).distinct()


def names_minus(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).subtract(b.select(*keys))


def lifecycle_status(aligned: DataFrame) -> DataFrame:
    status = F.when(F.col("in_current") & ~F.col("in_master"), "New").when(F.col("in_current"), "Available").otherwise("Discontinued")
    return aligned.withColumn("status", status)


def _field(side: str, name: str, df: DataFrame) -> Column:
    return F.col(f"{side}.{name}") if name in df.schema[side].dataType.names else F.lit(None).cast("string")


def lifecycle_dates(aligned: DataFrame, as_of: str, prefer_master_dates: bool = False) -> DataFrame:
    """first_seen_date and last_seen_date; needs status. The archive's date is that of its snapshot (column snapshot_date)."""
    today = F.date_format(F.to_date(F.lit(as_of)), "dd-MM-yyyy")
    archived = F.col("in_archive") & (~F.col("in_master") if prefer_master_dates else F.lit(True))
    snapshot = F.coalesce(_field("arc", "snapshot_date", aligned), F.lit("Unknown"))

    def date(name: str) -> Column:
        kept = F.coalesce(_field("mas", name, aligned), F.lit("Unknown"))
        known = T.to_dd_mm_yyyy(_field("mas", "first_seen_date", aligned), as_of) if name == "first_seen_date" else today
        return F.when(F.col("status") == "New", today).when(F.col("status") == "Available", known).when(archived, snapshot).otherwise(kept)

    return aligned.withColumn("first_seen_date", date("first_seen_date")).withColumn("last_seen_date", date("last_seen_date"))


def record_precedence(aligned: DataFrame, columns: list[str]) -> DataFrame:
    """Row data from current, else archive, else master."""
    rest = [c for c in aligned.columns if c not in ("cur", "arc", "mas", *columns)]
    pick = lambda c: F.when(F.col("in_current"), _field("cur", c, aligned)).when(F.col("in_archive"), _field("arc", c, aligned)).otherwise(_field("mas", c, aligned)).alias(c)
    return aligned.select(*rest, *[pick(c) for c in columns])


def update_master(current: DataFrame, archive: DataFrame, master: DataFrame, keys: list[str], as_of: str, prefer_master_dates: bool = False, buckets: int | None = None) -> DataFrame:
    """The new master: all keys of the three sides with status, dates and the row data that goes first; text fields cleaned.

    With prefer_master_dates the dates of a discontinued row come from the master where it has the row, not from the archive. `buckets`: see lifecycle_join.
    """
    skip = {*keys, *STATE, "ord", "snapshot_date"}
    columns = list(dict.fromkeys(c for df in (current, archive, master) for c in df.columns if c not in skip))
    aligned = lifecycle_dates(lifecycle_status(lifecycle_join(current, archive, master, keys, buckets=buckets)), as_of, prefer_master_dates)
    out = record_precedence(aligned, columns).select(*keys, *columns, "status", "first_seen_date", "last_seen_date", F.lit(as_of).alias("last_updated"))
    return clean_fields(out, skip=keys)


def clean_fields(df: DataFrame, skip: list[str] = ()) -> DataFrame:
    """clean_field on every text column."""
    return df.select(*[T.clean_field(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.simpleString() == "string" and f.name not in skip else F.col(f"`{f.name}`") for f in df.schema])


def update_master_two_way(current: DataFrame, master: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """Without archive, in the order of the report."""
    return sort_by_status_name(update_master(current, current.limit(0), master, keys, as_of), keys[-1])


def sort_by_status_name(df: DataFrame, name: str = "name") -> DataFrame:
    place = F.when(F.col("status") == "Available", 0).when(F.col("status") == "New", 1).otherwise(2)
    return df.orderBy(place, name)


def status_lines(master: DataFrame, name: str = "name", price: str = "price") -> DataFrame:
    """name, price label, the date that matters for the status, and the report that the row belongs to; one pass over the master."""
    date = F.when(F.col("status") == "New", F.col("first_seen_date")).otherwise(F.col("last_seen_date"))
    return master.where(F.col("status").isin("New", "Available", "Discontinued")).select(name, T.price_label(F.col(price)).alias("price_label"), date.alias("date"), F.col("status").alias("report"))


def status_reports(master: DataFrame, name: str = "name", price: str = "price") -> dict[str, DataFrame]:
    """A table for each status: name, price label and the date that matters."""
    lines = status_lines(master, name, price)
    return {s: lines.where(F.col("report") == s).drop("report") for s in ("New", "Available", "Discontinued")}


def update_all_brands(current: DataFrame, archive: DataFrame, master: DataFrame, as_of: str, prefer_master_dates: bool = False) -> DataFrame:
    """One job for all brands: the key is brand and name."""
    return update_master(current, archive, master, ["brand", "name"], as_of, prefer_master_dates)


def lifecycle_replay(snapshots: DataFrame, keys: list[str], date: str = "snapshot_date") -> DataFrame:
    """Fold of all dated snapshots: first and last seen, status from the newest snapshot of the brand (the first key)."""
    seen = snapshots.groupBy(*keys).agg(F.min(date).alias("first_seen"), F.max(date).alias("last_seen"))
    newest = snapshots.groupBy(keys[0]).agg(F.max(date).alias("_newest"))
    out = seen.join(newest, keys[0])
    status = F.when(F.col("last_seen") < F.col("_newest"), "Discontinued").when(F.col("first_seen") == F.col("_newest"), "New").otherwise("Available")
    return out.withColumn("status", status).drop("_newest")

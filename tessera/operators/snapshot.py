"""Snapshots of the state and their differences, as outer joins by primary key."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPARED = {
    "document": ("document_id",), "document_version": ("version_id",), "derivation": ("derivation_key",), "artifact": ("artifact_id",), "access_control": ("document_id", "tenant_id"),
}
#: Columns that any scan moves, whether anything changed or not.
IGNORED: Mapping[str, tuple[str, ...]] = {"document": ("last_seen_at", "last_seen_scan_id", "last_fingerprint_at")}
CONTENT_TABLES = ("document_version", "derivation", "artifact")

Tables = Mapping[str, DataFrame]


def normalized(df: DataFrame, keys: Iterable[str], ignored: Iterable[str] = ()) -> DataFrame:
    """key, and cells: a map from every other column to its text. Booleans are 0 and 1, bytes are hex, nulls stay null."""
    keys, skip = list(keys), {*keys, *ignored}

    def text(name: str, kind: str):
        c = F.col(f"`{name}`")
        if kind == "boolean":
            c = c.cast("int")
        return F.lower(F.hex(c)) if kind == "binary" else F.to_json(F.struct(c)) if kind.startswith(("array", "struct", "map")) else c.cast("string")

    cells = [(n, text(n, k)) for n, k in sorted(df.dtypes) if n not in skip]
    made = F.create_map(*[x for n, c in cells for x in (F.lit(n), c)]) if cells else F.create_map().cast("map<string,string>")
    return df.select(F.concat_ws("\0", *[F.col(k).cast("string") for k in keys]).alias("key"), made.alias("cells"))


def assert_unique(snapshot: DataFrame, table: str) -> None:
    twice = snapshot.groupBy("key").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate primary key in {table}: {twice[0]['key']!r}")


def snapshot_state(t: Tables, ignored: Mapping[str, Iterable[str]] = IGNORED) -> dict[str, DataFrame]:
    """The compared tables by key, and the set of (kind, document) of the observations."""
    out = {name: normalized(t[name], keys, ignored.get(name, ())) for name, keys in COMPARED.items() if name in t}
    if "observation" in t:
        out["observation_kinds"] = t["observation"].select("kind", F.coalesce("document_id", F.lit("-")).alias("document_id")).distinct()
    return out


def diff_rows(before: DataFrame, after: DataFrame, table: str) -> DataFrame:
    """(table, key, change, column, before, after): added and removed rows once, changed rows once a column that changed."""
    j = before.select("key", F.col("cells").alias("b"), F.lit(True).alias("in_b")).join(after.select("key", F.col("cells").alias("a"), F.lit(True).alias("in_a")), "key", "full_outer")
    change = F.when(F.col("in_b").isNull(), "added").when(F.col("in_a").isNull(), "removed").otherwise("changed")
    empty = F.array(F.lit(None).cast("string"))
    # an absent cell and a null one are the same
    names = F.array_sort(F.array_union(F.map_keys("a"), F.map_keys("b")))
    moved = F.filter(names, lambda n: ~F.element_at("a", n).eqNullSafe(F.element_at("b", n)))
    rows = j.withColumn("change", change).withColumn("columns", F.when(F.col("change") == "changed", moved).otherwise(empty))
    rows = rows.select("key", "change", "a", "b", F.explode("columns").alias("column"))
    cell = lambda m: F.when(F.col("column").isNotNull(), F.element_at(m, F.col("column")))
    return rows.select(F.lit(table).alias("table"), "key", "change", "column", cell("b").alias("before"), cell("a").alias("after"))


def diff_snapshots(before: Tables, after: Tables, ignored: Mapping[str, Iterable[str]] = IGNORED) -> DataFrame:
    """All differences of two states; observation kinds that came or went are rows of the table ``observation_kinds``."""
    a, b = snapshot_state(before, ignored), snapshot_state(after, ignored)
    parts = [diff_rows(a[n], b[n], n) for n in COMPARED if n in a and n in b]
    if "observation_kinds" in a and "observation_kinds" in b:
        tag = F.concat_ws("\0", "kind", "document_id").alias("key")
        none = [F.lit(None).cast("string").alias(x) for x in ("column", "before", "after")]
        for x, y, change in ((b, a, "added"), (a, b, "removed")):
            rows = x["observation_kinds"].subtract(y["observation_kinds"])
            parts.append(rows.select(F.lit("observation_kinds").alias("table"), tag, F.lit(change).alias("change"), *none))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def is_empty_diff(diff: DataFrame) -> bool:
    return diff.limit(1).count() == 0


def rows_added(before: Tables, after: Tables) -> DataFrame:
    """Rows of the content tables that only the second state has, as findings."""
    parts = []
    for name in CONTENT_TABLES:
        keys = COMPARED[name]
        key = F.concat_ws(" / ", *[F.col(k).cast("string") for k in keys])
        rows = after[name].select(*keys).join(before[name].select(*keys), list(keys), "left_anti")
        parts.append(rows.select(F.concat(F.lit(f"{name}["), key, F.lit("]")).alias("subject"), F.lit("").alias("detail")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def as_findings(diff: DataFrame) -> DataFrame:
    return diff.select(F.concat_ws(" ", "table", F.regexp_replace("key", "\0", " / "), "change").alias("subject"), F.coalesce("column", F.lit("")).alias("detail"))


def format_diff(diff: DataFrame, most: int = 100) -> str:
    rows = diff.orderBy("table", "key", "column").limit(most).collect()
    return "\n".join(f"{r['change']} {r['table']}[{(r['key'] or '').replace(chr(0), ' / ')}]" + (f" {r['column']}: {r['before']} -> {r['after']}" if r["column"] else "") for r in rows)


def assert_same_state(before: Tables, after: Tables) -> None:
    diff = diff_snapshots(before, after)
    if not is_empty_diff(diff):
        raise AssertionError(format_diff(diff))

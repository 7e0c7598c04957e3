"""Keyed changes of tables, as the state after the change: upsert, prune, delete."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Like replace, but columns in keep stay where the new value is NULL."""
    a, b = old.alias("a"), new.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]
    cols = []
    for c in old.columns:
        if c in keys or c in keep:
            cols.append(F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c))
        else:
            cols.append(F.when(F.col(f"b.{keys[0]}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return a.join(b, on, "full").select(*cols)


def prune(rows: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Rows whose key is still there."""
    return rows.join(current.select(key), key, "left_semi")


def delete_under(rows: DataFrame, path: str, prefixes: Sequence[str]) -> DataFrame:
    """Rows not within one of the directories (a file of that very path stays); blank prefixes delete nothing, % and _ are ordinary."""
    own = [p for p in (x.strip().strip("/") for x in prefixes) if p]
    cond = F.lit(False)
    for p in own:
        cond = cond | F.startswith(F.col(path), F.lit(p + "/"))
    return rows.where(~F.coalesce(cond, F.lit(False)))


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table (with its key column) without the rows that belong to the keys in gone."""
    out = {}
    for name, (rows, own) in tables.items():
        out[name] = rows.join(gone.select(F.col(key).alias(own)), own, "left_anti")
    return out


def changed(new: DataFrame, known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key (an id with a content hash) isn't known yet."""
    return new.join(known.select(*keys), list(keys), "left_anti")

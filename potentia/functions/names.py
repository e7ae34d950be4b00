"""Names of models and datasets, resolved by small tables that the caller writes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key) if table else F.lit(None).cast("string")


def resolve_model(name: Column, aliases: dict[str, str], known: list[str]) -> Column:
    """SRC13: a model's canonical name. In this order: an alias as written, in lower case; a known name as written (without slashes at
    its end), in any case; the one known name that has its last part; else the name itself. Blank names are empty."""
    raw = F.trim(name)
    plain = F.rtrim(raw, F.lit("/"))
    in_any_case: dict[str, str] = {}
    by_base: dict[str, list[str]] = {}
    for k in known:
        in_any_case.setdefault(k.lower(), k)
        by_base.setdefault(k.rstrip("/").split("/")[-1].lower(), []).append(k)
    single = {base: own[0] for base, own in by_base.items() if len(own) == 1}
    return F.when(raw == "", raw).otherwise(
        F.coalesce(
            _lookup(aliases, raw), _lookup(aliases, F.lower(raw)), F.when(plain.isin(known), plain), _lookup(in_any_case, F.lower(plain)),
            _lookup(single, F.lower(F.substring_index(plain, "/", -1))), name,
        )
    )


def by_prefix(name: Column, table: dict[str, tuple], default: tuple) -> list[Column]:
    """SRC14: the values of the longest of the table's names that begins this one, in any case; else the defaults (None: the name itself)."""
    out = [name if x is None else F.lit(x) for x in default]
    for prefix in sorted(table, key=len):
        fits = F.startswith(F.lower(name), F.lit(prefix.lower()))
        out = [F.when(fits, F.lit(x)).otherwise(rest) for x, rest in zip(table[prefix], out)]
    return out

"""What rules are learned from: one row per pair, with the source record, its history and its reason row as canonical
columns, and the target's fields as canonical text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import normalize as n

#: Structs of a pair that are features, and how their columns' names begin.
SIDES = {"s": "src", "hist": "hist", "reason": "reason"}


@dataclass
class Features:
    """``df`` has pair_id, the columns of ``kinds`` and the columns named in ``targets`` (field to column)."""

    df: DataFrame
    kinds: dict[str, str]
    targets: dict[str, str]


def kind_of(kind: T.DataType) -> str | None:
    """string, double, date or boolean; None for what is no scalar."""
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    if isinstance(kind, T.NumericType):
        return "double"
    return {T.StringType: "string", T.BooleanType: "boolean"}.get(type(kind))


def feature_table(pairs: DataFrame, fields: list[str], hidden: tuple[str, ...] = ()) -> Features:
    """``pairs`` has pair_id, s, d and, if looked up, hist and reason. ``fields`` of the target become targets; source
    columns in ``hidden`` are left out. Pairs with one record only are none."""
    columns, kinds, targets = [F.col("pair_id")], {}, {}
    for side, prefix in SIDES.items():
        for f in pairs.schema[side].dataType.fields if side in pairs.columns else ():
            if (kind := kind_of(f.dataType)) and not (side == "s" and f.name in hidden):
                name, value = f"{prefix}_{f.name}", F.col(f"{side}.`{f.name}`")
                kinds[name] = kind
                columns.append((n.clean(value) if kind == "string" else n.clean_number(value) if kind == "double" else value.cast("date") if kind == "date" else value).alias(name))
    for f in pairs.schema["d"].dataType.fields:
        if f.name in fields and (kind := kind_of(f.dataType)):
            targets[f.name] = f"y_{f.name}"
            value = F.col(f"d.`{f.name}`")
            columns.append((F.when(n.clean(value).rlike(r"^\d{4}-\d{2}-\d{2}"), n.date_key(value)).otherwise(n.key(value)) if kind == "string" else n.key(value, kind)).alias(f"y_{f.name}"))
    return Features(pairs.where("s is not null and d is not null").select(*columns), kinds, targets)

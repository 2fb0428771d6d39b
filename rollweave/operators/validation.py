"""Row validation against a declared model, with a report for each row.

Pydantic v2 is loaded only when it is used and runs once per Arrow batch and row. One Spark column has one type whether a row is valid or
not, so there are two forms of the result: input columns keep their raw types, or (``in_place``) those that the model declares get the
model's types, with coerced values and defaults in valid rows. Timestamps come back as dates.
"""

from __future__ import annotations

import json
import types
from collections.abc import Iterator
from datetime import date, datetime
from decimal import Decimal
from typing import Annotated, Any, Literal, Union, get_args, get_origin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import need_frame
from ..log import get_logger
from ..plans.session import find_package

logger = get_logger(__name__)
COUNT, DETAILS, STATUS = "val_error_count", "val_error_details", "validation_status"


def _is_model(model) -> bool:
    return isinstance(model, type) and any(k.__name__ == "BaseModel" and k.__module__.startswith("pydantic") for k in model.__mro__)


def _check_model(model) -> None:
    """Pydantic models, and classes that offer the same ``model_validate``, ``model_dump`` and ``errors``."""
    if not isinstance(model, type):
        raise TypeError(f"model must be a class, not an instance of {type(model).__name__}")
    if not hasattr(model, "model_validate"):
        if _is_model(model):
            raise AttributeError("model has no 'model_validate'; Pydantic v2 is needed")
        try:
            import pydantic  # noqa: F401
        except ImportError:
            raise ImportError("validation against a model needs Pydantic") from None
        raise TypeError(f"{model.__name__} is no Pydantic model")


def _plain(v):
    """Missing values of any kind as None, numpy scalars and timestamps as Python's own."""
    if isinstance(v, (list, dict, tuple, set)) or v is None:
        return v
    if pd.isna(v):
        return None
    return v.to_pydatetime() if isinstance(v, pd.Timestamp) else v.item() if hasattr(v, "item") else v


def _told(errors: list[dict]) -> str:
    return "; ".join(f"'{e['loc'][-1] if e.get('loc') else 'Model Error'}': {e.get('msg')}" for e in errors)


_TYPES = {str: T.StringType(), bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), date: T.DateType(), datetime: T.DateType(), Decimal: T.DecimalType(38, 18)}
RAW = "val_raw_values"


def spark_type(annotation: Any) -> T.DataType | None:
    """Spark type of a field's annotation, without regard to None and constraints; None if there is no single one."""
    if get_origin(annotation) is Annotated:
        return spark_type(get_args(annotation)[0])
    if get_origin(annotation) is Literal:
        kinds = {type(v) for v in get_args(annotation) if v is not None}
    elif get_origin(annotation) in (Union, types.UnionType):
        return spark_type(inner[0]) if len(inner := [a for a in get_args(annotation) if a is not type(None)]) == 1 else None
    else:
        kinds = {annotation}
    return _TYPES.get(kinds.pop()) if len(kinds) == 1 else None


def _as_date(v):
    return v.date() if isinstance(v, datetime) else v


def _in_place(df: DataFrame, model: type, report: list[T.StructField]) -> DataFrame:
    """The report with the model's types: see ``error_report``."""
    declared = {n: t for n, f in model.model_fields.items() if (t := spark_type(f.annotation)) is not None}
    taken = (COUNT, DETAILS, STATUS, RAW)
    dated = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    own = [T.StructField(f.name, declared.get(f.name, T.DateType() if f.name in dated else f.dataType)) for f in df.schema.fields if f.name not in taken]
    more = [T.StructField(n, t) for n, t in declared.items() if n not in df.columns]
    fields = [*own, *more]
    schema = T.StructType([*fields, *report, T.StructField(RAW, T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pydantic import TypeAdapter, ValidationError

        singles = {n: TypeAdapter(model.model_fields[n].annotation) for n in declared}

        def alone(n: str, v):
            """A value of an invalid row as its field's type, or None if it isn't one."""
            if n not in singles or v is None:
                return v
            try:
                return singles[n].validate_python(v)
            except ValidationError:
                return None

        for batch in batches:
            rows = []
            for values in zip(*([_plain(v) for v in batch[c]] for c in batch.columns)):
                row = dict(zip(batch.columns, values))
                try:
                    made = row | model.model_validate(row).model_dump() | {COUNT: 0, DETAILS: None, STATUS: "Valid", RAW: None}
                except ValidationError as e:
                    told = e.errors()
                    made = {n: alone(n, v) for n, v in row.items()} | {COUNT: len(told), DETAILS: _told(told), STATUS: "Invalid", RAW: json.dumps(row, default=str)}
                rows.append([_as_date(made.get(f.name)) for f in schema.fields])
            out = pd.DataFrame(rows, columns=schema.names, dtype=object)
            whole = [f.name for f in schema.fields if isinstance(f.dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))]
            yield out.astype({n: "Int64" for n in whole} | {COUNT: "Int32"})

    return df.select(*(F.col(f"`{f.name}`") for f in own)).mapInPandas(run, schema)


def error_report(df: DataFrame, model: type, name: str = "table", cleaned: T.StructType | None = None, in_place: bool = False) -> DataFrame:
    """``df`` with val_error_count, val_error_details (null if valid) and validation_status (Valid or Invalid).

    ``cleaned``: fields of the model to return as a struct of that name, coerced and with defaults, null for invalid rows.
    ``in_place`` (Pydantic models): columns that the model declares have its types. Valid rows hold coerced values and defaults, also of fields
    that the table lacks; invalid rows hold what is right by itself and null elsewhere, and all their raw values as JSON in
    ``val_raw_values``. An empty table gives an empty report.
    """
    need_frame(df, "df")
    _check_model(model)
    find_package(df.sparkSession)
    logger.info("validation of %s against %s", name, model.__name__)
    report = [T.StructField(COUNT, T.IntegerType()), T.StructField(DETAILS, T.StringType()), T.StructField(STATUS, T.StringType())]
    if in_place:
        if not _is_model(model):
            raise TypeError(f"{model.__name__} declares no types; in_place needs a Pydantic model")
        return _in_place(df, model, report)
    raw = T.StructType([f for f in df.schema.fields if f.name not in (COUNT, DETAILS, STATUS)])
    schema = T.StructType([*raw.fields, *report, *([T.StructField("cleaned", cleaned)] if cleaned else [])])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts, details, good = [], [], []
            columns = [[_plain(v) for v in batch[c]] for c in batch.columns]
            for values in zip(*columns):
                row = dict(zip(batch.columns, values)) | {COUNT: 0, DETAILS: None, STATUS: "Valid"}
                try:
                    made = model.model_validate(row).model_dump(exclude_unset=False)
                    counts.append(0)
                    details.append(None)
                    good.append({f.name: made.get(f.name) for f in cleaned.fields} if cleaned else None)
                except Exception as e:
                    if not hasattr(e, "errors"):
                        raise
                    found = e.errors()
                    counts.append(len(found))
                    details.append(_told(found))
                    good.append(None)
            out = batch.copy()
            out[COUNT], out[DETAILS] = pd.array(counts, "int32"), pd.Series(details, index=batch.index, dtype=object)
            out[STATUS] = pd.Series(["Invalid" if n else "Valid" for n in counts], index=batch.index, dtype=object)
            if cleaned:
                out["cleaned"] = pd.Series([{k: v.date() if isinstance(v, datetime) else v for k, v in g.items()} if g else None for g in good], index=batch.index, dtype=object)
            yield out

    out = df.select(*(F.col(f"`{f.name}`") for f in raw.fields)).mapInPandas(run, schema)
    dates = {f.name: F.col(f"`{f.name}`").cast("date") for f in raw.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))}
    return out.withColumns(dates) if dates else out


def report_counts(report: DataFrame) -> DataFrame:
    """One row: rows, invalid rows, errors."""
    return report.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(STATUS) == "Invalid").alias("n_invalid"), F.coalesce(F.sum(COUNT), F.lit(0)).alias("n_errors"))

"""Readers for the physical tables, and the contract of a raw fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .schema import FACT_COLUMNS


def read_table(spark: SparkSession, data_dir: str, name: str) -> DataFrame:
    """``<data_dir>/<name>.parquet`` (a file or a directory of part files).

    Only a lazy scan: callers select the columns they need so that Catalyst
    prunes the Parquet read schema and pushes their filters into the scan.
    """
    return spark.read.parquet(f"{data_dir.rstrip('/')}/{name}.parquet")


class FactContractError(ValueError):
    """A table is not a raw fact; ``problems`` lists every reason."""

    def __init__(self, where: str, problems: list[str]):
        super().__init__(f"{where} is not a raw transfer fact: " + "; ".join(problems))
        self.problems = problems


# what each fact column may be; ids only need to be comparable
FACT_TYPES: dict[str, tuple[type[T.DataType], ...]] = {
    "id": (T.StringType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DecimalType, T.BinaryType),
    "created_at": (T.TimestampNTZType, T.TimestampType),
    "status": (T.StringType,),
    "simplified_status": (T.StringType,),
    "data": (T.StringType, T.VariantType),
}


def conform_fact(df: DataFrame, where: str = "the table", extra: str = "drop") -> DataFrame:
    """``df`` as a raw fact: exactly ``FACT_COLUMNS``, in that order, each of a type the normaliser reads.

    Only the schema is looked at, so nothing runs.  Missing, repeated and
    wrongly typed columns raise one ``FactContractError`` that names them all.
    Further columns are left out of the scan, or are an error with
    ``extra="error"``.  Names match without regard to case, as Spark resolves
    them.
    """
    if extra not in ("drop", "error"):
        raise ValueError(f"extra must be 'drop' or 'error', not {extra!r}")
    found: dict[str, list[T.StructField]] = {}
    for field in df.schema.fields:
        found.setdefault(field.name.lower(), []).append(field)
    problems = []
    for name in FACT_COLUMNS:
        fields = found.pop(name, [])
        if not fields:
            problems.append(f"column {name} is missing")
        elif len(fields) > 1:
            problems.append(f"column {name} is there {len(fields)} times")
        elif not isinstance(fields[0].dataType, FACT_TYPES[name]):
            problems.append(f"column {name} is {fields[0].dataType.simpleString()}, not "
                            + " or ".join(t.typeName() for t in FACT_TYPES[name]))
    if extra == "error" and found:
        problems.append("unknown columns " + ", ".join(sorted(found)))
    if problems:
        raise FactContractError(where, problems)
    return df.select(*FACT_COLUMNS)


def read_fact(spark: SparkSession, source: str | DataFrame, fmt: str | None = "parquet", extra: str = "drop") -> DataFrame:
    """A raw transfer fact, checked against its contract when it is loaded (``conform_fact``).

    ``source`` is the path of a table stored as ``fmt``, the name of a catalog
    table or view with ``fmt=None``, or a relation that is already at hand.
    """
    if isinstance(source, DataFrame):
        return conform_fact(source, extra=extra)
    df = spark.table(source) if fmt is None else spark.read.format(fmt).load(source)
    return conform_fact(df, source, extra)

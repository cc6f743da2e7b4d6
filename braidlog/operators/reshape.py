"""Case-control tables: strata, long to wide, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BOOKKEEPING = {"stratum", "event", "IS_OBSERVED", "rid", "sender", "receiver"}


def case_column(data: DataFrame, case: str | None) -> str:
    found = case or next((c for c in ("event", "IS_OBSERVED") if c in data.columns), None)
    if found is None or found not in data.columns:
        raise ValueError("no case indicator")
    return found


def derive_stratum(data: DataFrame, case: str | None = None, stratum: str | None = None, order_col: str = "rid", within: Sequence[str] = ()) -> DataFrame:
    """data with the stratum of each row in __stratum.

    A named column is carried forward over null and empty values in the order of order_col; without one a
    stratum begins at each case. Both follow one order of all rows, so within should name columns
    (a file, a day) that no stratum crosses: each of their values is numbered by itself.
    """
    order = Window.partitionBy(*within).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    if stratum:
        value = F.col(stratum).cast("string")
        return data.withColumn("__stratum", F.last(F.when(value != "", value), ignorenulls=True).over(order))
    number = F.sum((F.col(case_column(data, case)) == 1).cast("long")).over(order)
    return data.withColumn("__stratum", F.concat_ws("/", *[F.col(c).cast("string") for c in within], number.cast("string")))


def numeric_covariates(data: DataFrame, leave: Sequence[str]) -> list[str]:
    gone = {*leave, *_BOOKKEEPING}
    return [f.name for f in data.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in gone and not f.name.startswith("__")]


def widen_case_control(
    data: DataFrame, case: str | None = None, stratum: str | None = None, covariates: Sequence[str] | None = None, control_index: int = 1, keep_ids: bool = True, order_col: str = "rid", check: bool = False,
) -> DataFrame:
    """One row per stratum: the case and its control_index-th control in the order of order_col.

    stratum, sender and receiver as _ev and _nv if keep_ids, and for each covariate its case (_ev) and
    control (_nv) values and their difference (d_). Strata without exactly one case or with fewer
    controls are left out; check: it is an error if none remains. Covariates are by default all numeric
    columns that aren't bookkeeping.
    """
    case = case_column(data, case)
    if control_index < 1:
        raise ValueError("control_index counts from 1")
    if stratum and data.schema[stratum].dataType.typeName() not in ("string",) or stratum == "stratum":
        rows = data.withColumn("__stratum", F.col(stratum).cast("string"))
    else:
        rows = derive_stratum(data, case, stratum, order_col)
    covariates = list(covariates) if covariates is not None else numeric_covariates(data, [case, stratum or "stratum", order_col])
    if missing := [c for c in covariates if c not in data.columns]:
        raise ValueError(f"no columns {', '.join(missing)}")
    ids = [c for c in ("sender", "receiver") if keep_ids and c in data.columns]
    carried = F.struct(F.lit(0).alias("__none"), *ids, *[F.col(c).cast("double").alias(c) for c in covariates])
    is_case = F.col(case) == 1
    # The n-th control is the greatest of the first n in order, found without a sort of the stratum.
    ranked = rows.select("__stratum", is_case.alias("__case"), F.col(order_col).alias("__order"), carried.alias("__row"))
    place = F.row_number().over(Window.partitionBy("__stratum", "__case").orderBy("__order"))
    ranked = ranked.withColumn("__place", place)
    wide = ranked.groupBy("__stratum").agg(
        F.count(F.when(F.col("__case"), 1)).alias("__cases"),
        F.max(F.when(F.col("__case"), F.col("__row"))).alias("__ev"),
        F.max(F.when(~F.col("__case") & (F.col("__place") == control_index), F.col("__row"))).alias("__nv"),
    )
    wide = wide.filter("__cases = 1 AND __nv IS NOT NULL")
    if check and wide.isEmpty():
        raise ValueError("no stratum has one case and enough controls")
    pick = [F.col("__stratum").alias("stratum")]
    pick += [F.col(f"__{side}.{c}").alias(f"{c}_{side}") for side in ("ev", "nv") for c in ids]
    for c in covariates:
        ev, nv = F.col(f"__ev.{c}"), F.col(f"__nv.{c}")
        pick += [ev.alias(f"{c}_ev"), nv.alias(f"{c}_nv"), (ev - nv).alias(f"d_{c}")]
    return wide.select(*pick)

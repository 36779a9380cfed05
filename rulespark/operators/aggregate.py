"""The aggregators as Spark aggregations.

Contributions (a0, ..., value, key, rule) are a bag: equal ones count separately. Every fold
is one grouped aggregation with partial results before the shuffle; conflicts and values that
an aggregator does not take are found in the same pass.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulespark.functions import types as ty
from rulespark.functions import values as vals
from rulespark.functions.builtins import OVERFLOW

IDEMPOTENT = {"min=", "max=", "|=", "&=", ":-", "set="}


def item_type(aggregator: str, t):
    """The type of an item's value, from that of its aggregands."""
    if t is None:
        return None
    if aggregator in ("set=", "bag=", "dict="):
        return ty.settle(("list", t)) if t != "term" else "term"
    if aggregator == "mean=":
        return "double" if t != "term" else "term"
    if aggregator in (":-", "|=", "&="):
        return "bool"
    return t


def _null(t) -> Column:
    return F.col("value") == "z" if t == "term" else F.col("value").isNull()


def fold(frame: DataFrame, columns: list[str], t, key, aggregator: str, nullable: bool) -> tuple[DataFrame, DataFrame | None]:
    """(items with value and key, failed items with message).

    ``t``: type of the aggregands; ``key``: type of their keys, or None; ``nullable``: whether a
    null can be among them. A relation without arguments and without contributions has no item.
    """
    v = F.col("value")
    failing: Column | None = None
    if t == "term" and aggregator not in (":=", "=", "majority=") or aggregator in ("min=", "max=") and key == "term":
        return _by_python(frame, columns, t, key, aggregator)
    message = lambda text: F.lit(f"AggregatorError: `{aggregator}` {text}")
    aggs: dict[str, Column] = {}
    value: Column
    keyed: Column | None = None
    if aggregator == ":=":
        aggs["hi"] = F.max(F.struct(F.col("rule"), v.alias("v")))
        aggs["lo"] = F.min(F.struct((-F.col("rule")).alias("rule"), v.alias("v")))
        value = F.col("hi.v")
        failing = F.when(~F.col("hi.v").eqNullSafe(F.col("lo.v")), F.concat_ws(" ", message("got conflicting values for rule index"), F.col("hi.rule").cast("string")))
    elif aggregator == "=":
        aggs["hi"], aggs["lo"] = F.max(v), F.min(v)
        value = F.col("lo")
        failing = F.when(F.col("hi") != F.col("lo"), message("got conflicting values"))
    elif aggregator in ("min=", "max="):
        pick = F.min if aggregator == "min=" else F.max
        if key is None:
            aggs["best"] = pick(v)
            value = F.col("best")
        else:
            aggs["best"] = pick(F.struct(v.alias("v"), F.col("key").alias("k")))
            value, keyed = F.col("best.v"), F.col("best.k")
    elif aggregator == "+=" and t in ty.NUMERIC:
        aggs["total"] = F.try_sum(v) if t == "long" else F.sum(v)
        value = F.col("total")
        if t == "long":
            aggs["some"] = F.max(v.isNotNull())
            failing = F.when(F.col("total").isNull() & F.col("some"), F.lit(f"{OVERFLOW} of `+=`"))
    elif aggregator == "+=" and t == "str":
        aggs["all"] = F.array_sort(F.collect_list(v))  # the order of strings is fixed, for one result
        value = F.array_join("all", "")
    elif aggregator == "*=" and t == "double":
        aggs["total"] = F.product(v)
        value = F.col("total")
    elif aggregator == "*=" and t == "long":
        # Exact: at most 62 factors beyond one fit into a long; ones, signs and zeros are counted.
        aggs["big"] = F.collect_list(F.when(F.abs(v) > 1, F.abs(v)))
        aggs["minus"] = F.count(F.when(v < 0, 1))
        aggs["zero"] = F.count(F.when(v == 0, 1))
        product = F.aggregate("big", F.lit(1).cast("long"), F.try_multiply)
        value = F.when(F.col("zero") > 0, F.lit(0).cast("long")).otherwise(F.when(F.col("minus") % 2 == 1, -product).otherwise(product))
        failing = F.when((F.col("zero") == 0) & product.isNull(), F.lit(f"{OVERFLOW} of `*=`"))
    elif aggregator == "mean=" and t in ty.NUMERIC:
        aggs["mean"] = F.avg(v)
        value = F.col("mean")
    elif aggregator == "majority=":
        aggs["most"] = F.mode(v, True)
        value = F.col("most")
    elif aggregator in ("|=", "&=", ":-") and t == "bool":
        aggs["flag"] = F.bool_or(v) if aggregator == "|=" else F.bool_and(v)
        value = F.col("flag")
        if aggregator == ":-":
            failing = F.when(~F.col("flag"), F.lit("TypeError: false is no value for `:-`"))
    elif aggregator in ("set=", "dict="):
        aggs["set"] = F.array_sort(F.collect_set(v))
        value = F.col("set")
    elif aggregator == "bag=":
        aggs["bag"] = F.array_sort(F.collect_list(v))
        value = F.col("bag")
    else:
        aggs["none"] = F.lit(None)
        value = F.lit(None).cast(ty.ddl(item_type(aggregator, t)))
        failing = F.lit(f"TypeError: a value of type {t if isinstance(t, str) else t[0]} is no value for `{aggregator}`")
        aggs = {"n": F.count("*")}
    if nullable and aggregator != ":=":
        aggs["nulls"] = F.count(F.when(_null(t), 1))
        own = F.when(F.col("nulls") > 0, F.lit(f"TypeError: null is no value for `{aggregator}`"))
        failing = own if failing is None else F.coalesce(own, failing)
    if not columns:
        aggs["rows"] = F.count("*")
    grouped = frame.groupBy(*columns).agg(*(c.alias(f"_{n}") for n, c in aggs.items()))
    grouped = grouped.select(*columns, *(F.col(f"_{n}").alias(n) for n in aggs))
    if not columns:
        grouped = grouped.where("rows > 0")
    shown = [*columns, value.alias("value"), *([keyed.alias("key")] if keyed is not None else [F.lit(None).cast(ty.ddl(key)).alias("key")] if key is not None else [])]
    if failing is None:
        return grouped.select(*shown), None
    good = grouped.where(failing.isNull())
    items = good.select(*shown)
    if aggregator == ":=" and nullable:
        items = items.where("value <> 'z'" if t == "term" else "value is not null")
    return items, grouped.where(failing.isNotNull()).select(*columns, failing.alias("message"))


def _by_python(frame: DataFrame, columns: list[str], t, key, aggregator: str):
    """Folds of values without a static type: grouped aggregation in Python."""
    to = item_type(aggregator, t)
    values = ty.encoded(F.col("value"), t)
    keys = F.lit("z") if key is None else F.coalesce(ty.encoded(F.col("key"), key), F.lit("z"))

    @F.pandas_udf("string")
    def folded(rules: pd.Series, values: pd.Series, keys: pd.Series) -> str:
        rows = [(int(r), vals.decode(v), vals.decode(k)) for r, v, k in zip(rules, values, keys, strict=True)]
        try:
            item = vals.fold(aggregator, rows)
            return None if item is None else "+" + vals.encode(item)
        except vals.EvaluationError as e:
            return "-" + vals.error_text(e)

    grouped = frame.withColumn("value", values).withColumn("key", keys).groupBy(*columns).agg(folded("rule", "value", "key").alias("f"))
    grouped = grouped.where("f is not null")
    good, text = grouped.where("f like '+%'"), F.expr("substring(f, 2)")
    pair = ty.from_python(lambda v: v, [(text, "term")], ("list", "term"))
    parts = good.withColumn("pair", pair)
    shown = [*columns, ty.decoded(F.get("pair", F.lit(0)), to).alias("value") if to != "term" else F.get("pair", F.lit(0)).alias("value")]
    if key is not None:
        got = F.get("pair", F.lit(1))
        shown.append((got if key == "term" else ty.decoded(got, key)).alias("key"))
    return parts.select(*shown), grouped.where("f like '-%'").select(*columns, text.alias("message"))

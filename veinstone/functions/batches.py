"""Python functions on columns, called once for each Arrow batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import functions as F, types as T


def batched(f: Callable, returns: T.DataType, arrow: pa.DataType):
    """A column function that applies f to each distinct value of a batch once; f must depend on its value alone."""

    def run(values: pa.Array) -> pa.Array:
        if pa.types.is_nested(values.type):
            return pa.array([f(v) for v in values.to_pylist()], arrow)
        coded = values.dictionary_encode(null_encoding="encode")
        made = pa.array([f(v) for v in coded.dictionary.to_pylist()], arrow)
        return made.take(coded.indices)

    run.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)

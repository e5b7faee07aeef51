"""Arrow UDFs that can be declared before there is a session."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def arrow_udf(kind: str):
    """Decorator: a function of pandas Series as a column function; its type (DDL) is parsed at the first use."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return wrap

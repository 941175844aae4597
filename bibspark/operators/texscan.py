"""TeX specials of field values as rows, and their escaping, in Arrow batches."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import tex

#: Occurrences listed for one value; the others are counted in a row of their own.
MOST = 256


def occurrences(values: DataFrame, most: int = MOST) -> DataFrame:
    """(id, at, char, context, verdict, omitted) of the specials of (id, text) that are not ignored.

    Beyond `most` in a value a last row without a place says how many are `omitted`; a value with such a row is not fixed.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                kept = [(ident, i, c, x, v, 0) for i, c, x in tex.specials(text or "") if (v := tex.verdict(c, x)) != "ignore"]
                rows += kept[:most] + ([(ident, None, None, None, "omitted", len(kept) - most)] if len(kept) > most else [])
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["id", "at", "char", "context", "verdict", "omitted"])

    return values.select(F.col("id").cast("long"), "text").mapInArrow(run, "id long, at int, char string, context string, verdict string, omitted long")


@F.pandas_udf(T.StringType())
def escape(text: pd.Series) -> pd.Series:
    return text.map(tex.escaped, na_action="ignore")

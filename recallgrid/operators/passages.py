"""Passages: merging by title, prompts, answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recallgrid.functions.text import first_line


def merged_by_title(docs: DataFrame, text_col: str = "text", order: str = "doc_id", prefix: str = "Wikipedia Title: ") -> DataFrame:
    """(``head``, ``n``, ``merged``): passages of the same first line as one: the first as it is, behind the prefix, then the others' bodies, without
    line ends around them, each on a new line, in order.  Null texts are left out.

    The result is one text for each title, as long as its passages together."""
    head, body = first_line(F.col(text_col)), F.col(text_col)
    rest = F.regexp_replace(F.substr(body, F.length(head) + 1), r"^\n+|\n+\z", "")
    own = F.struct(F.col(order).alias("at"), body.alias("whole"), rest.alias("rest"))
    parts = F.transform(F.sort_array(F.collect_list(own)), lambda x, i: F.when(i == 0, x["whole"]).otherwise(x["rest"]))
    return docs.where(body.isNotNull()).groupBy(head.alias("head")).agg(F.count("*").alias("n"), F.concat(F.lit(prefix), F.array_join(parts, "\n")).alias("merged"))

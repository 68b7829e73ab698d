"""The SQL surface: views of the registry, a view of records, and the table function ``carve_at``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from ..functions import registry as R
from ..functions.view import View
from ..sources.readers import opened


@udtf(returnType="size long, ext string, validated boolean")
class CarveAt:
    """``carve_at(path, type, start, cap)``: what the walker of a type finds at a place of a source; no row if it rejects."""

    def eval(self, path: str, type: str, start: int, cap: int) -> Iterator[tuple]:
        source, signature = opened(path), R.SIGNATURES[R.ALIASES.get(type, type)]
        cap = min(signature.max_size, source.size - start, cap or signature.max_size)
        found = signature.walk(View(source.pread, source.size, start, cap), False) if cap > 0 and start >= 0 else None
        if found:
            yield min(found.size, source.size - start), found.ext, found.validated


def register(spark: SparkSession, records: DataFrame | None = None) -> None:
    """Temp views carve_signatures, carve_aliases, carve_groups, and carve_records if given; the function carve_at."""
    R.registry(spark).createOrReplaceTempView("carve_signatures")
    R.aliases(spark).createOrReplaceTempView("carve_aliases")
    R.groups(spark).createOrReplaceTempView("carve_groups")
    if records is not None:
        records.createOrReplaceTempView("carve_records")
    spark.udtf.register("carve_at", CarveAt)

"""One query per relational operator, over the given and derived tables."""

from __future__ import annotations

from foliospark.derive import BASE, base, view
from foliospark.operators import governance_sql  # noqa: F401  (fills the table of operators)
from foliospark.operators.relational import OPERATORS, apply, duckdb
from foliospark.registry import query


def _add(name: str) -> None:
    reads = OPERATORS[name][0]

    def run(spark, sf):
        return apply(name, spark, **{n: base(spark, sf, n) if n in BASE else view(spark, sf, n) for n in reads})

    run.__name__ = name
    query(name, duckdb(name), tuple(n for n in reads if n not in BASE))(run)


for _name in OPERATORS:
    _add(_name)

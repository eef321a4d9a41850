"""Every query of the core library with its SQL counterpart."""

from __future__ import annotations

from taxonaut.plans import labels, training
from taxonaut.plans.tables import QUERIES, SQL

MODULES = (labels, training)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)

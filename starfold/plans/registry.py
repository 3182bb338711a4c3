"""The queries of the engine, and the SQL that each must agree with."""

from __future__ import annotations

from starfold.plans import curves, figures, models, panels, stars, training

QUERIES = curves.QUERIES | stars.QUERIES | models.QUERIES | panels.QUERIES | training.QUERIES | figures.QUERIES
ORACLE_SQL = curves.ORACLE_SQL | stars.ORACLE_SQL | models.ORACLE_SQL | panels.ORACLE_SQL | training.ORACLE_SQL

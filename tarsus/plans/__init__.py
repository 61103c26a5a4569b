"""Queries over the test tables and the SQL they are held against."""

from tarsus.plans import audit, evaluation, files, problems, scalars

QUERIES: dict = {**evaluation.R.queries, **audit.R.queries, **scalars.R.queries, **files.R.queries, **problems.QUERIES}
ORACLE: dict = {**evaluation.R.oracle, **audit.R.oracle, **scalars.R.oracle, **files.R.oracle, **problems.ORACLE}

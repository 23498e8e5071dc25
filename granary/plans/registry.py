"""All queries over the tables of a data folder, by name, and the SQL that must give the same rows."""

from granary.plans import cleaning, evaluation, files, graphs, integration, knowledge, ladders, recovery, release, reports, texts  # noqa: F401  (they register their queries)
from granary.plans.base import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "best_quality_dedupe"

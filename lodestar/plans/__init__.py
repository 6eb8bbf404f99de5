"""Named queries over the tables, with the SQL that gives the same rows."""

from . import batching, retrieval, rollouts, scoring  # noqa: F401
from .base import ORACLE_SQL, QUERIES  # noqa: F401

"""Every query of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from loomspan.plans import answers, audits, confirmation, evidence, gates, layout, matching, memory, questions, search, structured, training
from loomspan.plans.base import Query

MODULES = (structured, search, training, audits, layout, matching, gates, evidence, memory, questions, confirmation, answers)
QUERIES: dict[str, Query] = {name: q for m in MODULES for name, q in m.R.queries.items()}
SQL: dict[str, str] = {name: s for m in MODULES for name, s in m.R.sql.items()}

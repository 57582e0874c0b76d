"""All queries over the driver tables, with the SQL each must agree with."""

from __future__ import annotations

from stratum.plans import graphs, relational, retrieval

QUERIES: dict = relational.Q | graphs.Q | retrieval.Q
ORACLES: dict = relational.SQL | graphs.SQL | retrieval.SQL

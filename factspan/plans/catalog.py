"""All registered queries outside the language-model subpackage."""

from __future__ import annotations

from factspan.plans import core, parsed, problems, workspace  # noqa: F401

QUERIES = {**core.QUERIES, **problems.QUERIES}
SQL = {**core.SQL, **problems.SQL}

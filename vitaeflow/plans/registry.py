"""All queries of the core, by name."""

from __future__ import annotations

from vitaeflow.plans import bulk_queries, eval_queries, experience_periods, match_queries, packed_skills, profile_queries, system_queries, text_queries

_MODULES = (text_queries, profile_queries, match_queries, eval_queries, system_queries, bulk_queries)


def queries() -> dict:
    out = {"p3_found": packed_skills.p3_found, "p4_found": experience_periods.p4_found}
    for m in _MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {"p4_found": experience_periods.P4_SQL}
    for m in _MODULES:
        out |= m.SQL
    return out

"""All registered queries and their check SQL."""

from functools import wraps

from streamwarden.plans import drifting, gating, healing, jobs, observing, routing
from streamwarden.session import prepare

_AREAS = (routing, healing, drifting, gating, observing, jobs)


def _prepared(query):
    @wraps(query)
    def run(spark, folder):
        return query(prepare(spark), folder)

    return run


QUERIES = {name: _prepared(query) for area in _AREAS for name, query in area.QUERIES.items()}
ORACLE = {name: sql for area in _AREAS for name, sql in area.ORACLE.items()}

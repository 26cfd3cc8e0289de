from journeykit.sources.visits import (
    VISITS_DDL,
    visits_from_events,
    load_visits,
    read_visits,
    write_visits,
)
from journeykit.sources.manifest import session_sizes, update_manifest
from journeykit.sources.tables import read_table, write_flat_events, write_split_by_session

__all__ = [
    "VISITS_DDL",
    "visits_from_events",
    "load_visits",
    "read_visits",
    "write_visits",
    "read_table",
    "write_flat_events",
    "write_split_by_session",
    "session_sizes",
    "update_manifest",
]

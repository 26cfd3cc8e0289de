"""journeykit — clickstream session and user-journey analytics on PySpark.

Every public function maps a ``DataFrame`` to a ``DataFrame`` using Spark's
built-in functions only, so Catalyst plans the whole chain (pruning, pushdown,
partial aggregation, exchange reuse) and it runs unchanged on a cluster.
"""

from journeykit.operators.flatten import preprocess_hits
from journeykit.operators.sessions import session_facts
from journeykit.operators.navigation import navigation_context
from journeykit.operators.url_params import url_params
from journeykit.operators.sequence_facts import sequence_session_facts
from journeykit.operators.enrich import enriched_events, session_source_flags
from journeykit.operators.transitions import page_transitions

__all__ = [
    "preprocess_hits",
    "session_facts",
    "navigation_context",
    "url_params",
    "sequence_session_facts",
    "enriched_events",
    "session_source_flags",
    "page_transitions",
]

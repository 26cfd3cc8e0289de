"""Training-data operators: near-duplicate search, language ID, line dedup,
fingerprints, archives, tokenisation, mixing, language-model scores, shards.

Each module holds one operator; ``queries`` registers a query for each. Nothing
else in the library imports this package.

Python functions of this package travel to the executors by value, so a job
does not depend on how the executors' import path is set.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

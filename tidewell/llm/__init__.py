"""Operators of a large-scale training-data pipeline.

Nothing outside this folder imports it (besides the guarded registration in
``__spark_entry__.py`` and ``corpus_pipeline.py``), so it can be removed whole.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their tasks: nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

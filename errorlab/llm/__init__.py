"""Operators of a training-data pipeline: detection, de-duplication, packing, output.

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries when the package is there.
"""

import sys

from pyspark import cloudpickle

# Tasks carry the code they run, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

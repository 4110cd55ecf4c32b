"""keelson: structural-risk analytics over code history, as lazy PySpark plans."""

import sys

from pyspark import cloudpickle

# Executors need no installed copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

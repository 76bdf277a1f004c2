"""Operators that prepare text for training language models.

Nothing else in the library imports this package. Its functions travel to the executors with the tasks that
use them, so that only the driver needs the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

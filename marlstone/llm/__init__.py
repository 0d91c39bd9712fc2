"""Operators for preparing training text and vectors at corpus scale.

Nothing else in the library imports this subpackage. Python functions that run on executors are pickled by
value, so a cluster needs numpy, pandas and pyarrow there but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

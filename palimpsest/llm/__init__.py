"""Training-data operators over document tables.

Self-contained: nothing else in the library imports this subpackage.  Every operator is a plain
function ``DataFrame -> DataFrame``; ``registry`` lists the queries that apply them to whole tables.
Functions of this subpackage travel to executors by value, so they need no copy of the package there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

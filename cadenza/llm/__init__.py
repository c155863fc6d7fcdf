"""Training-data operators: the ten corpus operators and their queries.

Nothing outside this folder imports it.  Functions that run inside Spark's
Python workers are pickled by value, so executors need no copy of this
package on their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

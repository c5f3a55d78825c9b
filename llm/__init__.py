"""Operators a training-data pipeline needs, each a function from DataFrame to DataFrame.

Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code: the package needs to be on the driver only
cloudpickle.register_pickle_by_value(sys.modules[__name__])

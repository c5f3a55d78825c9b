"""Event, stream and inference-log analytics as plain DataFrame functions."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code: the package needs to be on the driver only
cloudpickle.register_pickle_by_value(sys.modules[__name__])

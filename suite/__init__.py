"""One query per operator, with the SQL it is checked against."""

import sys

from pyspark import cloudpickle

# As the package itself: what runs in Python workers travels with its code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

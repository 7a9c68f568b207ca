"""Vacancia: posting analytics on Spark DataFrames.

``functions`` holds Column -> Column expressions, ``operators`` DataFrame -> DataFrame
steps, ``sources`` the mappers from landed feed payloads to the 25-field posting row and
``plans`` the compositions of them.
"""

import sys

from pyspark import cloudpickle

# functions that run on executors are sent whole, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

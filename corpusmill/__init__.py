"""corpusmill: a PySpark-native engine for documentation corpora.

Operators are plain ``DataFrame -> DataFrame`` functions; nothing here
starts a session or runs a job on import.
"""

from pyspark import cloudpickle as _cloudpickle

# Python functions of this package travel to the executors by value, so that a
# cluster needs no copy of the package on its workers.
_cloudpickle.register_pickle_by_value(__import__(__name__))

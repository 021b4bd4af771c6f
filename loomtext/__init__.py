"""A PySpark engine that reduces, ranks and selects text for language models."""

import sys

from pyspark import cloudpickle

# tasks carry the library's functions by value: executors need no copy of the repository
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""quillsift: prompt-injection scanning and corpus preparation as Spark DataFrame plans."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Executors need no copy of the package: its functions travel by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"

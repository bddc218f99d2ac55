"""logferry: collect, clean, batch and deliver log data with Spark DataFrames."""

import sys

from pyspark import cloudpickle

from logferry.settings import Settings

# Functions that run in tasks travel with the job, so executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]

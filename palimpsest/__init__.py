"""Palimpsest: a bi-temporal memory graph as Spark DataFrames.

Episodes, entities, facts and their links are plain DataFrames.  Every operator takes and
returns DataFrames, answers whole tables of queries in one job, and never asks for "now":
the caller passes ``reference_time``.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel whole, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

"""loupe — spot-check classification of partly labelled tables on Spark.

Every step is a DataFrame -> DataFrame operator built on Spark SQL and Spark ML:

* ``loupe.sources``   reading tables, prediction-run tables, reports, model bundles
* ``loupe.functions`` column expressions: cleaning, typing, hashing/splitting, text
* ``loupe.operators`` profiling, features, scalers, reductions, kNN, resampling,
                      classifiers, metrics, dark numbers
* ``loupe.plans``     the spot-check leaderboard and the train/evaluate/predict flow
"""

import sys

from pyspark import cloudpickle

from loupe.spec import TableSpec, SpotCheckSpec  # noqa: F401
from loupe.session import get_spark, checkpoint_dir  # noqa: F401

__all__ = ["TableSpec", "SpotCheckSpec", "get_spark", "checkpoint_dir"]

# Functions of this package travel to the Python workers by value, so that workers need not have
# the package on their path (a cluster's executors, or a driver started from another folder).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Dataset reliability audits as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from plumbline.roles import AssetThresholds, Roles, SeriesThresholds, TabularThresholds

# The few functions that run in Python workers travel with the task: executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["AssetThresholds", "Roles", "SeriesThresholds", "TabularThresholds"]

"""meterwise: many-sensor time-series anomaly detection as Spark plans."""

import sys

from pyspark import cloudpickle as _cloudpickle

from .config import DetectionConfig, Routes, config_from_dict

# Pandas UDFs defined in this package are shipped to the Python workers by
# value, so executors need no installed copy of the package.
_cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DetectionConfig", "Routes", "config_from_dict"]

"""Operators of a training-data pipeline. Nothing else in the package imports this folder."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Task functions of this folder travel with the job, so an executor needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

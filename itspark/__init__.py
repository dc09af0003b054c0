"""Linked-record cohorts and interrupted time series on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions sent to them carry their code along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from itspark.functions import axis, harmonic, recode
from itspark.operators import dedup, effects, link, model, panel, quality, serial, summary
from itspark.sources import delimited, spine, stage

__all__ = [
    "axis", "harmonic", "recode",
    "dedup", "effects", "link", "model", "panel", "quality", "serial", "summary",
    "delimited", "spine", "stage",
]

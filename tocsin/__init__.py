"""Episode-level alarm calibration on Spark DataFrames."""

from tocsin.params import Params

__all__ = ["Params"]

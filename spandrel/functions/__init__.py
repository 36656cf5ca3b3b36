"""Scalar functions by name: importing this package fills ``FUNCTIONS``."""

from spandrel.functions import collections, datetimes, jsons, maths, strings, values  # noqa: F401
from spandrel.functions.registry import FUNCTIONS  # noqa: F401
from spandrel.vector import distance  # noqa: F401

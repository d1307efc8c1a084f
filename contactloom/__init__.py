"""Business-contact extraction on Spark: listings, pages and robots bodies in, contact tables out."""

import sys

from pyspark import cloudpickle

from contactloom.fixed_values import Settings

# Arrow helpers travel with their tasks, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Settings"]

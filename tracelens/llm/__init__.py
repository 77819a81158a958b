"""Training-data operators: filters, deduplication, decontamination, counting, mixing and formats.

Nothing else in the library imports this subpackage.
"""

from pyspark import cloudpickle as _cloudpickle

import tracelens as _root

# Functions that run on executors travel with the plan, so executors need not have this package installed.
_cloudpickle.register_pickle_by_value(_root)

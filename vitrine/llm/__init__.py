"""Training-data operators: chat formatting, secret scans, similarity joins,
decontamination, sharding, licence scans, packing, token files, repeated
passages, quality rules, filter audits and conversation tries.  Nothing else in the library imports this package.

Functions of the package that run in tasks are sent by value, so executors
need not have the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for training-data work: quality, duplicates, decontamination, tokens, licenses, archives, secrets, language.

Nothing outside this subpackage imports it. Functions that run in tasks are sent to executors by value, so a
cluster needs the public libraries they use but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

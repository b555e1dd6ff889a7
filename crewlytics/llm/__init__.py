"""Operators for preparing language-model training data; nothing else in the library imports them.

Functions of this package travel to the executors by value, so a cluster needs numpy, pyarrow
and the tokenizer libraries on its workers, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Training-data operators: quality rules, decontamination, token files, URL
filters, near-dedup, chat formatting, packing, PII, quality classifier and
language-model scoring.  Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code: nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""quire: document-extraction analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

from quire.session import build_session, configure

# the small functions that run in Python tasks travel with the job; executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "configure"]

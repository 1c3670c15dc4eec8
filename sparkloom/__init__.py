"""Text, rule and graph analytics expressed as Spark plans."""

from pyspark import cloudpickle as _cloudpickle

import sparkloom as _self

# Worker-side functions travel inside the task, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_self)

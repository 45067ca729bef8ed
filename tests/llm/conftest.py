"""Functions of the package go to Python workers along with the job."""

from pyspark import cloudpickle

import pairloom

cloudpickle.register_pickle_by_value(pairloom)

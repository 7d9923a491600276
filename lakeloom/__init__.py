"""lakeloom: corpus analytics on Spark.

Web pages, documents, lines, headings, terms, URLs and embeddings are DataFrames; extraction, scanning, ranking,
search fusion and packing are declarative plans over them.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

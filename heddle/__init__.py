"""heddle: a Spark-native analytics engine for text-plus-vector memory stores.

Every operator takes DataFrames and returns DataFrames.  Catalyst plans the
relational work; Arrow-batched Python runs only where SQL has no expression
for the semantics.
"""

__version__ = "0.1.0"

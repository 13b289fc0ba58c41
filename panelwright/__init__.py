"""panelwright: dense area x week x category demand panels on Spark.

Every public function maps DataFrames (and plain configuration) to DataFrames.
"""

__version__ = "0.1.0"

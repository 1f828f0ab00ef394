"""memlake: Spark-native analytics over tables of personal-context memory records.

Every operator is a plain function that takes DataFrames (and Columns) and
returns DataFrames (or Columns).  Nothing here holds a session at module level
and no operator collects rows to the driver.
"""

from memlake.session import get_spark, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"

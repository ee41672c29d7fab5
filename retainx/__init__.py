"""retainx — customer-churn analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame. The heavy
lifting is declarative (DataFrame / SQL / Spark ML) so Catalyst can prune,
push down and plan it; the driver only ever sees bounded metadata such as
column names or per-column decisions.
"""

from retainx.params import Params

__all__ = ["Params"]
__version__ = "0.1.0"

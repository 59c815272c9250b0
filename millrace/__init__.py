"""millrace: composable DataFrame operators for time series, ontologies, code and text retrieval, and waveforms.

Every operator is a function ``DataFrame -> DataFrame`` that only declares a plan; nothing runs before
an action, save where an operator writes an intermediate table to the shared folder (``plans.shared``).
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Workers of a cluster need not have this package installed: its functions travel with the plan.
register_pickle_by_value(sys.modules[__name__])

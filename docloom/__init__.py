"""docloom: document retrieval and chat-log analytics as Spark jobs.

Every operator is a ``DataFrame -> DataFrame`` or ``Column -> Column``
function; nothing unbounded passes through the driver or one task.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# The functions Spark runs in Python travel with the job, so the executors
# need not have this package installed.
register_pickle_by_value(sys.modules[__name__])

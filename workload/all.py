"""Import every query module, in the order of the operator inventory."""

from workload import fixtures  # noqa: F401
from workload import q_checks  # noqa: F401
from workload import q_routing  # noqa: F401
from workload import q_tables  # noqa: F401
from workload import q_text  # noqa: F401
from workload import q_amounts  # noqa: F401
from workload import q_store  # noqa: F401
from workload import q_reports  # noqa: F401
from workload import q_analysis  # noqa: F401
from workload import q_files  # noqa: F401

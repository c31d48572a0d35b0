"""The registered checks: each Spark query with the SQL that must give the same rows."""

from checks.registry import CHECKS
import checks.profile_checks  # noqa: F401, E402
import checks.quality_checks  # noqa: F401, E402
import checks.clean_checks  # noqa: F401, E402
import checks.eda_checks  # noqa: F401, E402
import checks.chart_checks  # noqa: F401, E402
import checks.insight_checks  # noqa: F401, E402
import checks.source_checks  # noqa: F401, E402

__all__ = ["CHECKS"]

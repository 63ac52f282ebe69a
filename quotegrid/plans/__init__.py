"""Registered queries; importing this package fills the registry."""

from quotegrid.plans import study  # noqa: F401
from quotegrid.plans import prepare  # noqa: F401
from quotegrid.plans import learning  # noqa: F401
from quotegrid.plans import trading  # noqa: F401
from quotegrid.plans import policies  # noqa: F401
from quotegrid.plans import checks  # noqa: F401
from quotegrid.plans import live  # noqa: F401
from quotegrid.plans.registry import ORACLES, QUERIES  # noqa: F401

"""Queries over the driver tables; importing this package registers them."""

from contestlake.plans import standings  # noqa: F401
from contestlake.plans import resampling  # noqa: F401
from contestlake.plans import actions  # noqa: F401
from contestlake.plans import identities  # noqa: F401
from contestlake.plans import pages  # noqa: F401
from contestlake.plans import signals  # noqa: F401
from contestlake.plans import scenarios  # noqa: F401
from contestlake.plans import recomputes  # noqa: F401
from contestlake.plans import graphs  # noqa: F401
from contestlake.plans import relational  # noqa: F401
from contestlake.plans import feeds  # noqa: F401
from contestlake.plans import streams  # noqa: F401
from contestlake.plans import marts  # noqa: F401
from contestlake.plans import overviews  # noqa: F401
from contestlake.plans.registry import ORACLES, QUERIES  # noqa: F401

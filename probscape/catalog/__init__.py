"""Every operator as a registered query."""

from probscape.catalog.base import ORACLES, QUERIES  # noqa: F401
from probscape.catalog import augment, features, geometry, jobs, metadata, sources, space  # noqa: F401

"""Imports every query module, so that all queries are registered."""

import catalog.landing  # noqa: F401
import catalog.loops  # noqa: F401
import catalog.profiles  # noqa: F401
import catalog.repairs  # noqa: F401
import catalog.rules  # noqa: F401
import catalog.versions  # noqa: F401

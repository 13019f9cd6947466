"""Column functions; every one is an expression over built-ins."""

from cairn.functions.names import *  # noqa: F403
from cairn.functions.paths import *  # noqa: F403
from cairn.functions.places import *  # noqa: F403
from cairn.functions.prose import *  # noqa: F403

"""Checks and transforms of single values, as column expressions."""

from pactframe.functions.arrays import *  # noqa: F403
from pactframe.functions.coerce import *  # noqa: F403
from pactframe.functions.comparison import *  # noqa: F403
from pactframe.functions.files import *  # noqa: F403
from pactframe.functions.formats import *  # noqa: F403
from pactframe.functions.numbers import *  # noqa: F403
from pactframe.functions.strings import *  # noqa: F403
from pactframe.functions.temporal import *  # noqa: F403

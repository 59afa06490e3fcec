"""All registered queries of the library proper."""

from __future__ import annotations

from lectern.registry import Registry

REGISTRY = Registry()

from lectern.plans import books as _books  # noqa: E402
from lectern.plans import content as _content  # noqa: E402
from lectern.plans import files as _files  # noqa: E402
from lectern.plans import functions as _functions  # noqa: E402
from lectern.plans import more as _more  # noqa: E402
from lectern.plans import reader as _reader  # noqa: E402
from lectern.plans import releases as _releases  # noqa: E402
from lectern.plans import search as _search  # noqa: E402
from lectern.plans import steps as _steps  # noqa: E402
from lectern.plans import streams as _streams  # noqa: E402
from lectern.plans import values as _values  # noqa: E402

for _module in (_search, _reader, _content, _functions, _more, _values, _steps, _files, _books, _streams, _releases):
    _module.register(REGISTRY)

"""Streaming: keep the normalised base up to date as raw transfers arrive.

The dashboard's reports are batch queries over a closed date range, so no
report runs as a stream.  What does run incrementally is the normalisation:
``normalize`` is a stateless filter + projection, so it applies unchanged to a
streaming DataFrame, and each micro-batch is appended to the base table the
reports read.  The per-user first transfer date -- the one measure that
needs the whole history -- is kept current by a streaming aggregation
(``start_first_seen_stream``, or ``start_first_seen_state`` for a table that
stays at one row a user), so the new-user reports need not rescan it.  The
measures behind the time reports are kept by ``start_cells_stream``.
"""

from .base_stream import start_base_stream
from .cells_stream import StreamedCells, start_cells_stream
from .first_seen_state import read_first_seen, start_first_seen_state
from .first_seen_stream import compact_first_seen, first_seen_table, start_first_seen_stream

__all__ = ["start_base_stream", "start_cells_stream", "StreamedCells", "start_first_seen_state", "read_first_seen",
           "start_first_seen_stream", "first_seen_table", "compact_first_seen"]

"""Plans: the dashboard suite, the registered query catalog, storage and session settings."""

from .dashboard import DERIVED_NAMES, REPORT_NAMES, Dashboard, materialize_base
from .session import RECOMMENDED_CONF, local_session
from ..sources.storage import checkpoint_root, ensure_checkpoint_dir, scratch_path, write_and_reload

__all__ = [
    "DERIVED_NAMES", "REPORT_NAMES", "Dashboard", "materialize_base", "RECOMMENDED_CONF",
    "local_session", "checkpoint_root", "ensure_checkpoint_dir", "scratch_path", "write_and_reload",
]

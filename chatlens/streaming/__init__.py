from chatlens.streaming.jobs import Emission, run_available, start  # noqa: F401
from chatlens.streaming.sinks import (  # noqa: F401
    latest_rows,
    to_csv,
    to_jdbc,
    to_keyed_log,
    to_log,
    to_table,
    to_versions,
)
from chatlens.streaming.grace import mark_late, to_kept_and_late  # noqa: F401
from chatlens.streaming.versions import VersionedTable, to_compacted, to_keyed  # noqa: F401

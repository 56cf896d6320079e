from chatlens.plans.blocked import digest, met, numbered, ranged, with_running  # noqa: F401
from chatlens.plans.lineage import discard, materialize, materialize_dealt, scratch_path, shuffles_removed  # noqa: F401

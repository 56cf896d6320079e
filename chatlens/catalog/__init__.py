from chatlens.catalog.oracle import oracle_sql  # noqa: F401
from chatlens.catalog.queries import queries  # noqa: F401

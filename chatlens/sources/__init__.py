from chatlens.sources.log import chat_log, chat_log_files, decode_messages, enrich_from_envelope  # noqa: F401
from chatlens.sources.tables import jdbc_table, parquet_table  # noqa: F401

from chatlens.functions.scalars import (  # noqa: F401
    average_text,
    count_words,
    delivery_delay_ms,
    instant_text,
    is_chat_topic,
    is_invalid_login,
    is_valid_chat_name,
    local_time_text,
    offset_sum,
    offsets_array,
    rounded_ms,
    session_expiry,
    session_token,
    window_text,
)

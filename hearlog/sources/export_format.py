"""The record format of an audio-history export, all fields nullable."""

FILE_GLOB = "Streaming_History_Audio_*.json"
NUMBERED_FILE = r"_\d+\.json$"

# Export field, Spark type, column of the play table.
FIELDS = [
    ("ts", "string", "ts"),
    ("platform", "string", "platform"),
    ("ms_played", "bigint", "ms_played"),
    ("conn_country", "string", "conn_country"),
    ("ip_addr", "string", "ip_addr"),
    ("master_metadata_track_name", "string", "track_name"),
    ("master_metadata_album_artist_name", "string", "artist_name"),
    ("master_metadata_album_album_name", "string", "album_name"),
    ("spotify_track_uri", "string", "track_uri"),
    ("episode_name", "string", "episode_name"),
    ("episode_show_name", "string", "show_name"),
    ("spotify_episode_uri", "string", "episode_uri"),
    ("audiobook_title", "string", "audiobook_title"),
    ("audiobook_uri", "string", "audiobook_uri"),
    ("audiobook_chapter_uri", "string", "chapter_uri"),
    ("audiobook_chapter_title", "string", "chapter_title"),
    ("reason_start", "string", "reason_start"),
    ("reason_end", "string", "reason_end"),
    ("shuffle", "boolean", "shuffle"),
    ("skipped", "boolean", "skipped"),
    ("offline", "boolean", "offline"),
    ("offline_timestamp", "string", "offline_timestamp"),
    ("incognito_mode", "boolean", "incognito_mode"),
]

# What one play is: two records that agree on all of these are copies.
PLAY_KEY = [
    "ts",
    "ms_played",
    "track_uri",
    "episode_uri",
    "audiobook_uri",
    "track_name",
    "episode_name",
]

# Display text that gets cleaned; identifiers stay as they are.
TEXT_COLUMNS = [
    "platform",
    "track_name",
    "artist_name",
    "album_name",
    "episode_name",
    "show_name",
    "audiobook_title",
    "chapter_title",
]

# Kind of a JSON value -> label in the field profile.
TYPE_LABELS = {
    "VOID": "NoneType",
    "STRING": "str",
    "BIGINT": "int",
    "BOOLEAN": "bool",
    "DOUBLE": "float",
    "DECIMAL": "float",
    "ARRAY": "list",
    "OBJECT": "dict",
}

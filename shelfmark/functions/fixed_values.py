"""Fixed values the operators must share with the catalog semantics they reproduce.

Everything below is data, not logic: word lists, lookup tables, thresholds and patterns whose exact
value decides whether a result is right.
"""

# --- fixed values: file kinds -------------------------------------------------------------------
AUDIO_EXTENSIONS = (
    "mp3", "m4a", "aac", "flac", "opus", "ogg", "oga", "wav", "aif", "aiff", "wma", "wv", "ape", "alac",
)
LOSSLESS_HIT_FORMATS = ("flac", "wav", "aif", "aiff", "ape", "wv", "alac")
HIT_AUDIO_FORMATS = LOSSLESS_HIT_FORMATS + ("mp3", "m4a", "aac", "opus", "ogg", "oga", "wma")
MATCHER_FORMATS = ("flac",)

# --- fixed values: listing columns, in export order ---------------------------------------------
CATALOG_COLUMNS = (
    "id", "title", "artist", "album", "album_artist", "year", "genre", "track_number", "disc_number",
    "duration_ms", "format", "codec", "bitrate", "sample_rate", "bits_per_sample", "lossless", "size",
    "has_artwork", "has_lyrics", "rel_path", "added_at", "mtime_ms",
)
MERGED_COLUMNS = (
    "album", "album_artist", "year", "track_number", "track_total", "disc_number", "genre", "isrc",
    "mb_recording_id", "mb_release_id",
)
EDITABLE_COLUMNS = (
    "title", "artist", "album", "album_artist", "year", "track_number", "track_total", "disc_number",
    "genre", "comment",
)
VERBATIM_COLUMNS = ("lyrics", "mb_recording_id", "mb_release_id", "mb_artist_id")
NO_ARTWORK = "Could not download artwork"
OPEN_ROWS = 500
FINISHED_ROWS = 150
NUMERIC_COLUMNS = ("year", "track_number", "track_total", "disc_number")
DERIVED_COLUMNS = ("audio_hash", "peaks", "loudness", "fingerprint", "fingerprint_raw")

# --- fixed values: job states -------------------------------------------------------------------
ACTIVE_STATUSES = ("resolving", "matching", "downloading", "processing", "tagging", "moving")
FINISHED_STATUSES = ("done", "failed", "skipped", "cancelled")
STATUSES = ("queued",) + ACTIVE_STATUSES + FINISHED_STATUSES
STATE_RANK = {"done": 6, "queued": 4, "skipped": 3, "failed": 2, "cancelled": 1}
ACTIVE_RANK = 5
LEGACY_PRESETS = {"mp3": "mp3-320", "opus": "opus", "flac": "flac"}
DEFAULT_PRESET = "mp3-320"

# --- fixed values: quality and confidence -------------------------------------------------------
CODEC_EFFICIENCY = {"opus": 1.6, "aac": 1.3, "vorbis": 1.3, "mp3": 1.0}
HIGH_BITRATE = 256
LOW_BITRATE = 192
CONFIDENCE_REJECT = 0.35
CONFIDENCE_LOW = 0.6
REVIEW_BELOW = 0.7
KIND_WEIGHT = {
    "album": 1.0, "ep": 0.7, "single": 0.6, "soundtrack": 0.5, "compilation": 0.35, "other": 0.3,
    "live": 0.2, "bootleg": 0.1,
}

# --- fixed values: fingerprints and series ------------------------------------------------------
DURATION_WINDOW_MS = 30_000
ACOUSTIC_THRESHOLD = 0.82
MAX_SHIFT = 200
MAX_RUN = 64
KEY_SHIFT_BITS = 18
MIN_OVERLAP = 16
SERIES_BUCKETS = 800
SERIES_SCALE = 32_768.0
SILENCE_LEVEL = -70.0
TARGET_LEVEL = -18.0

# --- fixed values: text patterns ----------------------------------------------------------------
UPLOAD_NOISE = (
    r"(?i)[(\[](?:official\s*(?:music\s*)?(?:video|audio|visualizer|lyric\s*video|hd\s*video)?|music\s*video"
    r"|lyrics?(?:\s*video)?|audio|visuali[sz]er|hd|hq|4k|explicit|clean|m/v|mv)[)\]]"
)
GUEST_CREDIT = r"\((?:feat|ft|with)\.?[^)]*\)|\[(?:feat|ft|with)\.?[^\]]*\]"
MATCH_KEY_DROPS = (
    r"\b(?:remaster(?:ed)?|\d{4} remaster(?:ed)?|mono|stereo|radio edit|single version|album version)\b"
)
ARTIST_SEPARATOR = r"(?is)\s*(?:,|;|/|&|\sx\s|\sand\s|\b(?:feat|ft)\b\.?).*"
COPY_NAME = r"(?i)(?:\(\s*(?:copy|\d+)\s*\)|\bcopy\b|\s-\s?copy)(?:\.[^.]+)?\z"
LIVE_TITLE = r"(?i)\b(?:live(?: at| in| from)?|unplugged|in concert|sessions?|bbc|mtv)\b"
VARIANT_MARKERS = (
    "live", "cover", "remix", "karaoke", "instrumental", "sped up", "slowed", "reverb", "nightcore", "8d",
    "acoustic", "extended", "1 hour", "hour loop", "tutorial", "reaction", "mashup", "bass boosted",
    "piano version", "demo",
)

# --- fixed values: title case -------------------------------------------------------------------
SMALL_WORDS = (
    "a", "an", "and", "as", "at", "but", "by", "en", "for", "if", "in", "nor", "of", "on", "or", "per",
    "the", "to", "vs", "via", "feat", "ft",
)
ROMAN_NUMERAL = r"(?i)^(?:i{2,3}|iv|vi{1,3}|ix|xi{0,3})$"
ACRONYM = r"^[A-Z0-9]{2,}$"

# --- fixed values: templates and filename fields ------------------------------------------------
DEFAULT_PATH_TEMPLATE = "{albumartist|artist}/{album|Singles}/[{track:02} - ]{title}"
TEMPLATE_FIELDS = ("title", "artist", "albumartist", "album", "year", "track", "disc", "genre", "ext")
FILENAME_FIELDS = {
    "artist": "artist", "title": "title", "album": "album", "albumartist": "album_artist", "year": "year",
    "track": "track_number", "tracknumber": "track_number", "disc": "disc_number", "genre": "genre",
    "ignore": None,
}
FORBIDDEN_IN_SEGMENT = r'[<>:"/\\|?*]'
SEGMENT_LIMIT = 180

# --- fixed values: judging lossless hits ---------------------------------------------------------
NUMBER_PREFIX = r"^(?:\d{1,2}[-.])?(\d{1,3})\s*[-.)]?\s+(?=\S)"
DASHED_PAIR = r"^(.+?)\s+[-–—]\s+(.+)\z"
LOSSLESS_VERDICTS = {
    "size": "unusual size", "title": "another title", "length": "wrong length", "artist": "artist not confirmed",
    "version": "another version (live, remix…)", "score": "weak match", "busy": "busy",
}
ACCEPTED = "accepted"
ARTIST_SHOWN = 0.5
ALBUM_SHOWN = 0.8
LEAST_FILE_BYTES = 2 * 1024 * 1024
LOSSLESS_WEIGHTS = {"timed": (0.35, 0.25, 0.4), "untimed": (0.55, 0.45, -0.1)}
MARKER_COST = 0.4

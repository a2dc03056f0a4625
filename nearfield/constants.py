"""Fixed values of the data model; results depend on them."""

GRID_DEG, BUFFER_DEG, EDGE_DEG = 5, 0.5, 1
ROWS, COLS = 36, 72
CELL_DEG = 0.5
CELL_ROWS, CELL_COLS = 360, 720
INDEX_VERSION = 1
MIN_ARTICLES = 4
EARTH_RADIUS_M = 6_371_000
HIGHLIGHT_WEIGHT = 104
MAX_RING = 36
REQUERY_M = 15
CANARY_DEG = 0.05
BACK_DET, DEGENERATE_DET = -1e-8, 1e-9
MAX_EDGE_RAD = 0.18
RADAR_BLIPS, RADAR_DEFAULT_M = 80, 1000
CACHED_TILES, SESSION_TTL_S, RETRY_AFTER_MS = 50, 3600, 1_800_000
#: Seconds until enrichment and until the map follow a scroll that settled.
DEBOUNCE_S, MAP_DEBOUNCE_S = 0.3, 0.15
PAGE_INFINITE, OVERSCAN = 200, 5
HEADING_MS = 250
#: Replay of a walk: ms an item, least and most ms of a phase.
WALK_LOCATE_MS, WALK_DESCENT_MS, WALK_BFS_MS, WALK_PULSE_MS = (70, 600, 4000), (70, 300, 1500), (40, 300, 1500), 900
DUMP_TABLES = ("geo_tags", "page")
LANGUAGES = ("en", "de", "fr", "es", "it", "ru", "zh", "pt", "pl", "nl", "ko", "ar", "sv", "ja")

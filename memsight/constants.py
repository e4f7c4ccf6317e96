"""Windows, classes, hardware levels and published counts."""

# Lead-time windows in seconds, in report order.
WINDOWS = {
    "1m": 60, "5m": 300, "10m": 600, "20m": 1200, "30m": 1800,
    "1h": 3600, "1d": 86400, "7d": 604800, "30d": 2592000,
}

# Failure types (1 UE-driven, 2 CE-driven, 3 other) and their report names.
FAILURE_TYPES = {1: "ue", 2: "ce", 3: "misc"}

# Spatial error classes, coarsest first.
COMPONENTS = ["socket", "channel", "bank", "row", "column", "cell", "random"]

# Levels of the hardware factors.
LEVELS = {
    "DRAM_model": ["A1", "A2", "B1", "B2", "B3", "C1", "C2"],
    "DIMM_number": [8, 12, 16, 24],
    "server_manufacturer": ["M1", "M2", "M3", "M4"],
}

# Thresholds of the spatial and hard/soft classes.
MIN_ERRORS = 1000      # a socket, channel or bank fault needs more errors than this
CELL_GAP = 60          # a cell fault has two errors at most this many seconds apart
HARD_SPAN = 43200      # a hard cell spans more seconds than this (half-even rounded days >= 1)
LOOKBACK = 2592000     # 30 days
RECENT = 300           # component features count the last 5 minutes

# Feature frequencies in seconds. 5d is the step the published "1d" tables were made with.
FREQUENCIES = {"5m": 300, "30m": 1800, "1h": 3600, "5d": 432000, "1d": 86400}

# Published counts of the original fleet. Pass them as parameter tables to
# reproduce the published ratios; the operators compute these from the inputs by default.
PUBLISHED_TOTAL_SERVERS = 258993
PUBLISHED_MONTHLY_SERVERS = [185961, 190428, 196497, 198658, 202245, 205709, 213998, 236471]
PUBLISHED_LEVEL_SERVERS = {
    "DRAM_model": [77670, 71641, 38006, 514, 10540, 32534, 15549],
    "DIMM_number": [35676, 151988, 7085, 51705],
    "server_manufacturer": [58161, 127818, 52931, 7544],
}
PUBLISHED_FAILURES = {1: 567, 2: 809, 3: 761}
PUBLISHED_ERRORS = {1: 269733, 2: 6897677, 3: 4181363}
PUBLISHED_PREDICTABLE = {
    1: [547, 483, 463, 422, 393, 357, 190, 133, 97],
    2: [792, 733, 668, 532, 388, 361, 257, 216, 166],
    3: [760, 758, 752, 744, 739, 723, 307, 233, 172],
}
# known positives by test split (1..3), for failure types 1, 2, 3
PUBLISHED_POSITIVES = {1: [46, 92, 51], 2: [35, 65, 54], 3: [40, 75, 48]}

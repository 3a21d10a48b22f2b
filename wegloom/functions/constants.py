"""Fixed values that define results."""

# Speeds in km/h by road class, seconds, metres and word lists; results depend on them as they stand.
SPEED_KMH = {
    "motorway": 60, "trunk": 50, "primary": 40, "secondary": 35, "tertiary": 30, "unclassified": 25, "residential": 20,
    "motorway_link": 30, "trunk_link": 30, "primary_link": 25, "secondary_link": 25, "tertiary_link": 20, "service": 10,
}
LOCAL_CLASSES = ("residential", "unclassified", "service")
OVERVIEW_CLASSES = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link")
LABEL_CLASSES = ("primary", "secondary", "tertiary", "trunk")
SCENARIOS = ("pagi", "siang", "sore", "malam")
POI_SECONDS = {"school": (20, 15, 5, 0), "market": (30, 20, 15, 5), "mall": (5, 15, 25, 10)}  # for 100 m
SIGNAL_SECONDS = (35, 25, 40, 15)
RAIL_SECONDS = (45, 30, 45, 20)
POI_RADII = {"school": 100.0, "market": 150.0, "mall": 200.0}
VMAX = 60 / 3.6
ACCESS_KEYS = ("motorcar", "motor_vehicle", "vehicle", "access")
ALLOWED_ACCESS = ("yes", "permissive", "designated", "official")
WIDTH_KEYS = ("width", "maxwidth", "maxwidth:physical")
DIMENSION_KEYS = ("maxheight", "maxweight", "maxaxleload", "maxlength")
DIRECTIONAL_ACCESS = ("access:forward", "access:backward", "vehicle:forward", "vehicle:backward", "motor_vehicle:forward", "motor_vehicle:backward", "motorcar:forward", "motorcar:backward")
POOR_SURFACES = ("sand", "mud", "ground", "dirt", "grass", "earth")
POOR_SMOOTHNESS = ("bad", "very_bad", "horrible", "very_horrible", "impassable")
OPEN_BARRIERS = ("no", "entrance", "cattle_grid", "toll_booth", "border_control")
GATES = ("gate", "swing_gate", "lift_gate")
SERVICE_EXCLUDED = ("alley", "parking_aisle", "driveway", "drive-through", "emergency_access")
TURN_KINDS = ("no_left_turn", "no_right_turn", "no_straight_on", "no_u_turn", "only_left_turn", "only_right_turn", "only_straight_on", "only_u_turn")
TURN_EXCEPTIONS = ("motorcar", "motor_vehicle", "vehicle")
FREE_GATE = "13321512874"
GATE_SECONDS = 10.0
REGION_BUFFER_M, POI_EXTRA_M = 10_000.0, 200.0
HOSPITAL_GAP_M, DUPLICATE_M, EARTH_M = 150.0, 250.0, 6_371_000.0
ACCESS_RADIUS_M, ATTACH_SNAP_M, PREPARE_SNAP_M, AMBIGUOUS_M, END_EPS = 1000.0, 50.0, 1000.0, 0.05, 1e-8
CELL_M, MAJOR_CELL_M, SHARDS = 500.0, 2000.0, 4
OTHER_FACILITY = r"\b(apotek|apotik|klinik|puskesmas|psikologi|psikolog|gym|laboratorium|bekam)\b"
HOSPITAL_PART = r"\b(gedung|icu|icc|pusat bedah|stroke center)\b"
SPECIAL_HOSPITAL = r"\b(khusus|ibu|anak|mata|jiwa|paru|tht|gigi|mulut|bedah|disabilitas|rsia|rskia|rskb|rsk|rsj|rsgm|rskgm)\b"
GENERAL_HOSPITAL = r"\b(rumah sakit|rs|rsu|rsud|rsup|rsi|rsiy|rspau)\b"
HOSPITAL_PREFIX = r"^(rumah sakit(?: umum(?: daerah| pusat)?)?|rsup|rsud|rsu|rsiy|rsi|rspau|rs)\b"
PLACE_WORDS = (("rsup", "rumah sakit umum pusat"), ("rsud", "rumah sakit umum daerah"), ("rs", "rumah sakit"), ("kost", "kos"), ("indekos", "kos"))
# WGS84 and the transverse Mercator zone 49 south.
UTM_A, UTM_F, UTM_K, UTM_LON0 = 6378137.0, 1 / 298.257223563, 0.9996, 111.0

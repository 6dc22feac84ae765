"""Class codes, names, thresholds. They must equal the published ones to give right results."""

# Scene-classification codes removed by the basic and, in addition, by the strict rule; cloud codes.
SCL_BASIC_INVALID = [0, 1, 2]
SCL_STRICT_INVALID = [3, 8, 9, 10]
CLOUD_INVALID = [1, 2, 3]

# Land-cover codes.
VEGETATION_CODES = [10, 20, 30, 40, 60, 90, 95, 100]
LANDCOVER_LABELS = [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 95, 100]
LANDCOVER_NAMES = {
    10: "LC_Tree",
    20: "LC_Shrub",
    30: "LC_Grass",
    40: "LC_Crop",
    50: "LC_Settlement",
    60: "LC_Sparse_Veg",
    70: "LC_Snow",
    80: "LC_Water",
    90: "LC_Wetland",
    100: "LC_Moss_Lichen",
}
LANDCOVER_GROUPS = {
    "forest": [10, 95],
    "shrub_grass": [20, 30],
    "cropland": [40],
    "other_vegetation": [60, 90, 100],
}

# Season names by label id.
SEASON_NAMES = {
    1: "Winter",
    2: "Spring",
    3: "Summer",
    4: "Autumn",
    5: "Hotter",
    6: "Cooler",
    7: "Dry",
    8: "Wet",
}

# Expected interval of every spectral index; the four bounded ones are critical outside [-1, 1].
INDEX_RANGES = {
    "NDVI": (-1.0, 1.0),
    "kNDVI": (0.0, 1.0),
    "NDMI": (-1.0, 1.0),
    "NDWI": (-1.0, 1.0),
    "NIRv": (-1.0, 1.0),
    "IRECI": (-1.0, 2.0),
    "CIRE": (-1.0, 25.0),
}
CRITICAL_INDICES = ["NDVI", "kNDVI", "NDWI", "NDMI"]
RAW_OPTICAL_BANDS = ["B02", "B03", "B04", "B8A"]
OPTICAL_INDICES = ["IRECI", "NDMI", "NIRv"]

REFLECTANCE_MAX = 10000.0
EARTH_MAX_HEIGHT = 8849.0
DB_FLOOR, DB_CEIL = -30.0, 5.0
SCALED_LIMIT = 5.0
CUBE_ID_PATTERN = r"2\d{3}-\d{4}-[A-Z]{3}"

"""Fixed values of the film model. They decide results, so they are stated here as plain numbers."""

# --- pixels -----------------------------------------------------------------------------------
MIN_TRANSMITTANCE = 1e-7
SAMPLE_MAX = {"uint8": 255.0, "uint16": 65535.0, "uint32": 4294967295.0}
FLOAT_SAMPLES = ("float16", "float32", "float64")
LUMINANCE = (0.2722287168, 0.6740817658, 0.0536895174)  # AP1 primaries
NONFINITE_LIMIT = 0.01
ROLL_STRIDE = 8

# --- print fit --------------------------------------------------------------------------------
PRINT_SHADOW = 0.001
PRINT_HIGHLIGHT = 0.995
PAPER_HIGHLIGHT_DENSITY = 0.04  # above paper white (ISO 6846)
PAPER_SHADOW_FRACTION = 0.9  # of the paper's maximum density (ISO 6846)
MAX_GRADE = 1.0
FLAT_PERCENTILE = 0.999
FLAT_TARGET = 0.8

# --- automatic calibration --------------------------------------------------------------------
NEUTRAL_FRACTION = 0.5
SHADOW_PERCENTILE = 0.999
HIGHLIGHT_PERCENTILE = 0.001
DENSITY_BINS = 20
MIN_PIXELS_PER_BIN = 200
MIN_SEPARATION = 0.1
MIN_ROLL_FRAMES = 6
DIFFERS_CC = 10.0
MID_TONES = (0.9, 1.5)
MID_TONE_SAMPLES = 13

# --- picked points ----------------------------------------------------------------------------
MIN_SCALE = 0.2
MAX_SCALE = 5.0
AMBER_CC = 5.0
RED_CC = 10.0
MIN_AGREEMENT_POINTS = 3
DUPLICATE_DENSITY = 0.05
DUPLICATE_COLOUR = 0.02
WEDGE_LOW = 0.005
WEDGE_HIGH = 0.995
PICK_ERROR = 0.005
RELIABILITY_STEPS = 1001
SNAP_RADIUS = 10
PATCH_RADIUS = 12

# --- scan consistency -------------------------------------------------------------------------
EXPOSURE_TOLERANCE_STOPS = 0.05
WHITE_BALANCE_TOLERANCE = 0.005
CAMERA_REFERENCE = "camera reference (D65)"
CAMERA_REFERENCE_VERSION = "4"
CAMERA_REFERENCE_PRESET = 4
# raw-editor modules that leave tone and colour alone
NON_TONAL_MODULES = (
    "rawprepare", "demosaic", "colorin", "colorout", "gamma", "flip", "crop", "clipping", "ashift",
    "lens", "denoiseprofile", "rawdenoise", "hotpixels", "cacorrect", "cacorrectrgb", "temperature",
    "highlights", "retouch", "spots", "finalscale", "dither", "overexposed", "rawoverexposed",
)

# --- run summary ------------------------------------------------------------------------------
LOW_GRADE_MARGIN = 0.25
LOW_GRADE_FRAMES = 5
GRADE_CAP_SLACK = 1e-6
MAX_NAMES = 4
MAX_CHECK_NAMES = 6

# --- files ------------------------------------------------------------------------------------
TIFF_SUFFIXES = (".tif", ".tiff")
RAW_SUFFIXES = (".nef", ".cr2", ".cr3", ".arw", ".raf", ".dng", ".orf", ".rw2")
PICTURE_SUFFIXES = (".jpg", ".jpeg", ".png")
RUN_LOG_NAME = "run-log.txt"
PROFILE_SOURCES = ("colorchecker", "anchor", "auto", "manual")
EDITABLE_FIELDS = ("film_stock", "process", "scanner", "notes")
PROVENANCE_KEY = "filmroll"

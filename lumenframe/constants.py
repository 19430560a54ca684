"""Values that results depend on and that must be exactly these."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Names:
    """Files and folders that a library keeps in its root; libraries that exist already have a prefix of their own."""

    prefix: str = ".media-library"

    @property
    def state(self) -> str:
        return f"{self.prefix}.json"

    @property
    def plan(self) -> str:
        return f"{self.prefix}-chunks.json"

    @property
    def texts(self) -> str:
        return f"{self.prefix}-ocr-text"

    @property
    def thumbnails(self) -> str:
        return f"{self.prefix}-thumbnails"

    @property
    def descriptions(self) -> str:
        return f"{self.prefix}-descriptions"


# Extensions, limits, thresholds and names of the library format.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tiff", "tif", "heic", "heif")
INDEX_FILE = "index.json"
MAX_SCAN_DEPTH = 4
MAX_IMPORT_DEPTH = 8
MAX_IMPORT_ERRORS = 5
HASH_BYTES = 65536
CHECKPOINT_ROWS = 250
TITLE_BAND = 0.06
SAMPLES_PER_GROUP = 10
WORD_THRESHOLD = 35
AREA_THRESHOLD = 0.05
SCORE_THRESHOLD = 0.45
LOW_TEXT = "Low Text"
HIGH_TEXT = "High Text"
EXPLICIT = "Explicit"
ROOT = "Root"
DESCRIPTION_SCHEMA = 1
PROMPT_VERSION = 1
THUMBNAIL_EDGE = 480
DETECTOR_EDGE = 320
DESCRIBE_EDGE = 1280
DESCRIBE_ENDPOINT = "http://localhost:1234/v1/chat/completions"
DESCRIBE_MODEL = "local-model"
DESCRIBE_MAX_TOKENS = 512
DESCRIBE_TEMPERATURE = 0.2

# The folder-name patterns behind the presets.
FOLDER_PATTERNS = {
    "YYYY-MM": r"^\d{4}-\d{2}$",
    "YYYY_MM": r"^\d{4}_\d{2}$",
    "MM-YYYY": r"^\d{2}-\d{4}$",
    "Month YYYY": r"^(?i)(January|February|March|April|May|June|July|August|September|October|November|December) \d{4}$",
}

# Title-bar endings of video sites, in order of priority.
VIDEO_MARKERS = (" - youtube", " – youtube", " — youtube", " - vimeo", " - youtube music")

# The detector's classes by index, those that count as explicit, and its confidences.
DETECTOR_CLASSES = (
    "FEMALE_GENITALIA_COVERED",
    "FACE_FEMALE",
    "BUTTOCKS_EXPOSED",
    "FEMALE_BREAST_EXPOSED",
    "FEMALE_GENITALIA_EXPOSED",
    "MALE_BREAST_EXPOSED",
    "ANUS_EXPOSED",
    "FEET_EXPOSED",
    "BELLY_COVERED",
    "FEET_COVERED",
    "ARMPITS_COVERED",
    "ARMPITS_EXPOSED",
    "FACE_MALE",
    "BELLY_EXPOSED",
    "MALE_GENITALIA_EXPOSED",
    "ANUS_COVERED",
    "FEMALE_BREAST_COVERED",
    "BUTTOCKS_COVERED",
)
EXPLICIT_CLASSES = (2, 3, 4, 5, 6, 14)
EXPLICIT_CONFIDENCE = 0.25
TOP_CLASSES = 6
TOP_CONFIDENCE = 0.01
NO_CLASS_LABEL = "No NudeNet class reached 1% confidence."

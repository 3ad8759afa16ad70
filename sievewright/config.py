"""Fixed values and schemas of the curation library."""

from __future__ import annotations

# Names, orders and limits.
SPLITS = ("train", "validation", "test")
CLASSES = ("real", "fake")
LABEL_INDEX = {"real": 0, "fake": 1}
POSITIVE_CLASS = "fake"
SPLIT_PRIORITY = {"test": 0, "validation": 1, "train": 2}
SPLIT_ALIASES = {"train": ("train", "training"), "validation": ("valid", "validation", "val"), "test": ("test", "testing")}
UPLOAD_SUFFIXES = (".jpg", ".jpeg", ".png")
POOL_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
MIN_SIDE, MAX_SIDE, MAX_BYTES = 32, 12_000, 25 * 1024 * 1024
RATIOS = (0.70, 0.15, 0.15)
SEED, CLASS_CAP = 42, 500
NEAR_THRESHOLDS = (0, 1, 3, 7, 15, 31, 63)
DEFAULT_THRESHOLD = 3
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)

MANIFEST_DDL = "image_id string, label string, split string, official_split string, source_file string, bytes bigint, md5 string, phash_hex string"
MANIFEST_FIELDS = tuple(x.strip().split()[0] for x in MANIFEST_DDL.split(","))


class CurationError(ValueError):
    """Wrong set-up: missing folders, impossible quotas, bad ratios. Problems of single rows are columns, not errors."""


def check_ratios(train: float, validation: float, test: float) -> None:
    if min(train, validation, test) < 0 or abs(train + validation + test - 1) > 1e-6:
        raise CurationError(f"split ratios must not be negative and sum to 1: {train}, {validation}, {test}")

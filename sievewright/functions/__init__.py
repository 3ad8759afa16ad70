"""Part of the dataset curation library."""

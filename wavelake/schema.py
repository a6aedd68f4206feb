"""Explicit schemas. Nothing in the library infers a schema from data."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the audio format.
SAMPLE_RATE = 48_000
FFT_SIZE = 960
HOP_SIZE = 480
SPECTRUM_BINS = 481
CLIP_LEVEL = 0.999

CLEAN_FIELDS = ["clean_dataset", "clean_speaker_id", "clean_language", "clean_accent"]
NOISE_FIELDS = ["noise_dataset", "noise_category"]


# Schemas are DDL texts: readers take them as they are, and importing this module needs no session.
SIGNAL_BLOCKS = ("signal_id STRING, block BIGINT, start BIGINT, samples ARRAY<FLOAT>")
WAV_BLOCKS = (
    "path STRING, sample_rate INT, channels INT, frames BIGINT, block BIGINT, start BIGINT, samples ARRAY<FLOAT>, error STRING"
)
PROBED = ("path STRING, sample_rate INT, channels INT, frames BIGINT, error STRING")

SEGMENT = (
    "STRUCT<source_start_sample: BIGINT, source_end_sample: BIGINT, "
    "destination_start_sample: BIGINT, destination_end_sample: BIGINT>"
)
# Both noise variants share one struct; the fields of the other variant stay null.
NOISE = (
    "STRUCT<source: STRING, noise_dataset: STRING, noise_category: STRING, placement: STRING, relative_gain_db: DOUBLE, "
    "normalization_rms: DOUBLE, n_events: INT, fade_samples: INT, events: ARRAY<" + SEGMENT + ">, start_sample: BIGINT, "
    "start_time_seconds: DOUBLE, end_sample: BIGINT, looped: BOOLEAN, source_start_sample: BIGINT, "
    "source_end_sample: BIGINT, chunks: ARRAY<" + SEGMENT + ">, source_original_sample_rate: INT, "
    "source_original_channels: INT, source_standardized_num_samples: BIGINT>"
)
REGIONS = "ARRAY<STRUCT<start_sample: BIGINT, end_sample: BIGINT>>"
SAMPLE_RECORD = (
    "sample_id STRING, split STRING, clean_source STRING, clean_output STRING, clean_dataset STRING, "
    "clean_speaker_id STRING, clean_language STRING, clean_accent STRING, clean_original_sample_rate INT, "
    "clean_original_channels INT, clean_source_standardized_num_samples BIGINT, clean_cropped BOOLEAN, "
    "clean_start_sample BIGINT, clean_end_sample BIGINT, clean_start_time_seconds DOUBLE, "
    "clean_duration_seconds DOUBLE, noisy_output STRING, noises ARRAY<" + NOISE + ">, num_noises INT, "
    "category_mode STRING, required_noise_categories ARRAY<STRING>, target_snr_db DOUBLE, measured_snr_db DOUBLE, "
    "snr_error_db DOUBLE, snr_measurement STRUCT<method: STRING, measured_on: STRING, active_regions: " + REGIONS + ", "
    "active_fraction: DOUBLE, detector: STRING>, composite_noise_scale DOUBLE, composite_noise_scale_db DOUBLE, "
    "output_gain DOUBLE, output_gain_db DOUBLE, clipping_prevented BOOLEAN, peak_amplitude DOUBLE, "
    "final_peak_amplitude DOUBLE, duration_seconds DOUBLE, sample_rate INT, channels INT, output_subtype STRING, "
    "output_container STRING, mp3_compression_level DOUBLE, random_seed BIGINT, generator_version STRING"
)
FAILED_ATTEMPT = ("sample_id STRING, attempt INT, random_seed BIGINT, error_type STRING, error STRING")
INVENTORY = (
    "clean ARRAY<STRUCT<path: STRING, size_bytes: BIGINT, clean_dataset: STRING, clean_speaker_id: STRING, "
    "clean_language: STRING, clean_accent: STRING>>, "
    "noise ARRAY<STRUCT<path: STRING, size_bytes: BIGINT, noise_dataset: STRING, noise_category: STRING>>, "
    "unreadable STRUCT<clean: ARRAY<STRUCT<path: STRING, error: STRING>>, noise: ARRAY<STRUCT<path: STRING, error: STRING>>>"
)
# Fixed value: column order of the training manifest.
MANIFEST_FIELDS = [
    "mixture_id", "split", "role", "category", "tier", "target_snr_db", "measured_snr_db_meta", "duration_sec_meta",
    "n_events", "clipping_flag_meta", "noisy_relpath", "clean_relpath", "meta_status", "meta_flags", "audio_status",
    "audio_flags", "sample_rate", "channels", "frames", "duration_sec", "peak_noisy", "peak_clean", "alignment_lag",
    "measured_snr_db_audio", "use_for_training", "use_for_selection", "provenance",
]
MANIFEST = T.StructType([T.StructField(name, T.StringType()) for name in MANIFEST_FIELDS])
# Fixed value: column order of the common result table.
RESULT_FIELDS = [
    "experiment", "mixture_id", "category", "tier", "target_snr_db", "input_snr_db", "output_snr_db",
    "snr_improvement_db", "stoi", "pesq", "pesq_note", "pesq_nb", "pesq_nb_note", "sample_rate", "duration_sec",
    "processing_time_sec", "rtf", "output_peak", "output_clipping_samples", "clean_path", "noisy_path", "output_path",
]

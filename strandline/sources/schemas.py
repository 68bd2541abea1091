"""Explicit schemas of every stored table; nothing is inferred."""

VIDEO = "video_id string, participant string, path string, fps double, duration_sec double"
FEATURES = "video_id string, clip_idx int, embedding array<float>"
CLIP_META = "video_id string, fps double, n_clips int, feature_dim int, model string, model_weight string, n_clip_frame int, stride int"
#: An older sidecar has other names for three fields.
CLIP_META_OLD = CLIP_META + ", delta_min int, vjepa_model string"
NARRATION = "narration_id bigint, video_id string, start_timestamp double, end_timestamp double, verb_classes array<int>"
TAXONOMY = "id int, key string, category string"
CLIP_LABELS = "video_id string, clip_idx int, verb bigint"
BOUNDARIES = "video_id string, t_sec double"
TOKENS = "video_id string, pos int, token int"
TOKEN_STATS = "video_id string, n_tokens long, n_unique long, codebook_size int, n_changes long, mean_run_length double, max_run_length long"
PARAMETERS = "name string, shape array<int>, data array<double>"
TRAIN_LOG = "epoch int, val_mse double, perplexity double"
METRICS = "target string, representation string, split string, model string, metric string, value double"

"""Schemas of the engine's tables."""

FRAMES = "frame_idx int, path string, width int, height int, channels int, data binary"
PIXELS = "frame_idx int, channel int, y int, x int, v double"
BLOCKS = "frame_idx int, channel int, block_id int, px array<double>"
COEFS = "frame_idx int, channel int, block_id int, c array<int>"
SCAN = "frame_idx int, channel int, seq bigint, coef int"
TOKENS = "frame_idx int, channel int, tok bigint, value int, run int"
CHUNKS = "frame_idx int, channel int, rle_bytes int, enc_len int, payload binary"
PROFILE = "fn string, duration_us string, compute_pct string, memory_pct string, registers string"
TIMINGS = "backend string, run int, seconds double"

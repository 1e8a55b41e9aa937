"""Thresholds that define the meaning of the assembly operators (fixed values)."""

MIN_QUERY_LEN = 100
SHORT_QUERY_LEN = 200
IDENTITY = 0.9
SHORT_IDENTITY_FACTOR = 0.8
END_VARIATION = 1000
END_IGNORE = 300
DISJUNCT_DISTANCE = 5000
MIN_SEGMENT_LEN = 100
KMER = 25
MISMATCH_RATIO, OVERHANG_RATIO = 0.05, 0.15
MATCH, MISMATCH, GAP = 1, -2, -4
DISAGREE_RATIO = 0.9
COVERAGE_BIN = 50
ANCHOR = 50
REGION_BIN = 500
INDEL_SIZE = 5
POLY_A_RATIO = 0.9
PAIR_SD, DISCORDANT_SD = 6, 3
INSERT_SAMPLE = 2000
MATCH_KINDS = ("perfect", "matched", "disjunct", "unmatched")

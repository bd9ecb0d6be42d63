"""Constants of the detectors, fixed by what they must compute."""

from __future__ import annotations

AGENTS = ("volume", "temporal", "auth", "payload", "sequence", "geo")
SLOW_DOS_PORTS = (80, 8080, 8000)
BENIGN_RATE_PORTS = (53, 123, 137, 138, 443, 5353, 67, 68)
EPHEMERAL = 49152
#: Batches of a tenant before which volume and payload (15) and sequence (30 that it was sent) stay silent.
WARMUP, SEQUENCE_WARMUP = 15, 30
#: Milliseconds between the requests of people (fixed values); their mean is what gaps are held against.
HUMAN_GAPS_MS = (200, 800, 1500, 3000, 500, 12000, 250, 7000, 1100, 4500, 300, 600, 9000, 2200, 800, 350, 18000, 1200, 500, 3300)
HUMAN_MEAN_MS = sum(HUMAN_GAPS_MS) / len(HUMAN_GAPS_MS)
#: Batches that the distribution of a metric remembers, and batches of a tenant that one task takes in order: histories are cut into such blocks, which hand on what the next ones need.
REMEMBERED, BLOCK = 500, 4096

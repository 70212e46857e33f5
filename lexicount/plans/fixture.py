"""Parameters for running the operators on the driver's synthetic tables.

The synthetic ``documents`` table uses languages en/de/es/fr and sources
src0..src19. Published byte premiums exist only for eng/nld/zho, so the
values below are TEST CONSTANTS, not published numbers.
"""
from __future__ import annotations

from ..config import REGISTER_GROUP_ORDER

# Test constants: byte premium per fixture language (not published values).
FIXTURE_PREMIUM = {"en": 1.0, "de": 1.05, "es": 0.98, "fr": 1.02}

# Test mapping from fixture source to register group (rule: i-th source -> group i mod 5).
FIXTURE_GROUPS = {f"src{i}": REGISTER_GROUP_ORDER[i % len(REGISTER_GROUP_ORDER)] for i in range(20)}

# Static mixture used by the plan queries (target token shares).
FIXTURE_WEIGHTS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
FIXTURE_MAX_EPOCHS = 2
FIXTURE_SEED = 12
FIXTURE_SEQ_LEN = 128


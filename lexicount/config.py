"""Parameters and fixed values.

Run parameters are frozen dataclasses (no YAML loader: the caller builds them).
Everything under "Fixed values" must equal the published definitions for the
results to be comparable; nothing else in the package hard-codes data.
"""
from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must not change: prior results depend on them)
# ---------------------------------------------------------------------------

# Byte premium per language (bytes needed relative to English for the same content).
BYTE_PREMIUM = {"eng": 1.000000, "nld": 1.051606, "zho": 0.935966}

# Languages of the published corpus, in order.
LANGS = ("eng", "nld", "zho")

# 3-letter to 2-letter language codes used by fine-tune result folders.
LANG_3_TO_2 = {"eng": "en", "nld": "nl", "zho": "zh"}

# Special tokens that every learned vocabulary must contain, in id order.
SPECIAL_TOKENS = ("<pad>", "<bos>", "<eos>", "<unk>")

# Fine-tune tasks expected per 2-letter language on the leaderboard.
EXPECTED_FINETUNE = {
    "en": ["arc", "belebele", "bmlama", "mnli", "sib200", "truthfulqa", "xnli"],
    "nl": ["arc", "belebele", "bmlama", "include", "mnli", "sib200", "truthfulqa"],
    "zh": ["arc", "belebele", "bmlama", "include", "mnli", "sib200", "truthfulqa", "xnli"],
}

# Tolerance under which two mixture deficits count as tied.
DEFICIT_TIE_TOLERANCE = 1e-6

# Default budget: 100M reference tokens, at most 10 epochs.
DEFAULT_BUDGET_REFERENCE_TOKENS = 100_000_000
DEFAULT_MAX_EPOCHS = 10



# Register groups of corpus categories (dataset card "Tokens Per Group").
REGISTER_GROUPS = {
    "child-directed-speech": "Transcription",
    "child-available-speech": "Transcription",
    "educational": "Education",
    "child-books": "Books, Wiki, News",
    "child-wiki": "Books, Wiki, News",
    "child-news": "Books, Wiki, News",
    "subtitles": "Subtitles",
    "padding-opensubtitles": "Padding",
    "padding-wikipedia": "Padding",
}
REGISTER_GROUP_ORDER = ("Transcription", "Education", "Books, Wiki, News", "Subtitles", "Padding")

# White space as the Unicode property White_Space, spelled as the inside of a character class: the
# shorthand \s means ASCII only in Java and RE2, but all of these in Python.
WHITE_SPACE = "\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

# Byte-level pre-tokenisation pattern (GPT-2 style), the same for Java, Python and (without the lookahead) RE2.
BYTE_LEVEL_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + WHITE_SPACE + r"\p{L}\p{N}]+"
    "|[" + WHITE_SPACE + "]+(?![^" + WHITE_SPACE + "])|[" + WHITE_SPACE + "]+"
)


# ---------------------------------------------------------------------------
# Run parameters
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class MixConfig:
    """Token-budgeted mixture of languages (or of any other key column).

    ``weights`` are static target token shares; ``schedule`` is a list of
    ``(frac_done, weights)`` stages and, when non-empty, overrides ``weights``.
    ``premium`` maps a key to its byte premium (reference tokens = raw / premium).
    """

    weights: dict[str, float] = field(default_factory=dict)
    schedule: tuple[tuple[float, dict[str, float]], ...] = ()
    budget_reference_tokens: int = DEFAULT_BUDGET_REFERENCE_TOKENS
    max_epochs: int = DEFAULT_MAX_EPOCHS
    seed: int = 12
    premium: dict[str, float] = field(default_factory=lambda: dict(BYTE_PREMIUM))
    category_whitelist: dict[str, list[str] | None] = field(default_factory=dict)

    @property
    def total_token_budget(self) -> int:
        return self.budget_reference_tokens * self.max_epochs


@dataclass(frozen=True)
class PackConfig:
    seq_len: int = 1024
    micro_batch_size: int = 32
    grad_accum_steps: int = 1
    world_size: int = 1

"""Settings shared by every job.

Thresholds and limits are call arguments everywhere; the values below are only their defaults.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's behaviour (stated as text, together).
# ---------------------------------------------------------------------------
SIMILARITY_THRESHOLD = 0.40      # a pair is a candidate when cosine >= this value
CONTRADICTION_THRESHOLD = 0.70   # a candidate is a contradiction when P(contradiction) >= this value
BATCH_SIZE = 32                  # micro-batch of the model hooks; training shard size
MAX_SEQ_LEN = 128                # token budget of a scored pair
NUM_PARAPHRASES = 2              # paraphrases kept per sentence
SNLI_LIMIT = 50_000              # rows sampled from the first NLI source
MNLI_LIMIT = 30_000              # rows sampled from the second NLI source
NLI_HEAD_LIMIT = 20_000          # NLI rows used for training
PARAPHRASE_SENTENCE_LIMIT = 200  # distinct premises that are paraphrased
SAMPLE_SEED = 42                 # seed of the exact samples and of the shard shuffle
WARMUP_FRACTION = 0.1            # warm-up steps = int(0.1 * steps)
SWEEP_THRESHOLDS = (0.30, 0.40, 0.50, 0.65)
LABEL_ORDER = ("entailment", "neutral", "contradiction")   # canonical class ids 0, 1, 2
STS_CONSISTENT_MIN = 3.5         # score >= 3.5 -> consistent
STS_CONTRADICTION_MAX = 2.0      # score <= 2.0 -> contradiction
EXPECTED_SCORE_WEIGHTS = (5.0, 2.5, 0.0)   # entailment, neutral, contradiction
FILTERED_REASON = "Sentences are topically dissimilar — treated as consistent by default."
MISSING_PAIR_REASON = "Both sentences are required."
MISSING_TEXT_REASON = "Document text is required."
PARAPHRASE_PROMPT = "paraphrase: "

# ---------------------------------------------------------------------------
# Fixed values of this engine's own built-in models (not from the reference).
# ---------------------------------------------------------------------------
# Negation words of the lexical scorer, in the four languages of the test corpus.
NEGATION_WORDS = ("not", "no", "never", "nicht", "kein", "keine", "pas", "jamais",
                  "nunca", "sin", "sans", "ohne")
# Abbreviations after which a period does not end a sentence.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "etc", "cf", "e.g", "i.e")
# Linear logits of the lexical scorer: intercept, cosine, jaccard, negation mismatch.
SCORER_WEIGHTS = {
    "entailment": (-1.5, 0.0, 6.0, -2.0),
    "neutral": (0.0, 0.0, 0.0, 0.0),
    "contradiction": (-2.0, 1.0, 0.0, 4.0),
}


@dataclass(frozen=True)
class Settings:
    similarity_threshold: float = SIMILARITY_THRESHOLD
    contradiction_threshold: float = CONTRADICTION_THRESHOLD
    batch_size: int = BATCH_SIZE
    max_seq_len: int = MAX_SEQ_LEN
    num_paraphrases: int = NUM_PARAPHRASES
    seed: int = SAMPLE_SEED
    sweep_thresholds: tuple = SWEEP_THRESHOLDS
    scorer_weights: dict = field(default_factory=lambda: dict(SCORER_WEIGHTS))
    # rows per block of the dense tiled similarity plan, sentences per block of the token join
    dense_block_rows: int = 2048
    token_block_rows: int = 256
    # range partitions of the distributed numbering (0 = use spark.sql.shuffle.partitions)
    rank_partitions: int = 0


DEFAULT = Settings()

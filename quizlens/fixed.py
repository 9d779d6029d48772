"""Values that results depend on."""

# Fixed values.
DOMAINS = ("math", "code", "stem")
LETTERS = "ABCDEFGH"
RARE_ZIPF = 3.0
EPSILON = 1e-6
TEST_FRACTION = 0.2
MAX_OPTIONS = 4
ITEM_CHUNK = 64
TOKEN_BUDGET = 24576
MAX_SEQS = 128
MAX_NEW_TOKENS = 192
MAX_INPUT_TOKENS = 512
FEATURE_SAMPLE = 15000
CONTROL_SAMPLE = 1000
SEED = 42
STRONG_AUROC = 0.75
MODERATE_AUROC = 0.60
CONFIRMED_GAP = 0.05
WEAK_GAP = 0.0
VARIANTS = ("original", "neutralized", "adversarial")
GROUPS = ("treatment", "control")
STYLE_OF_DOMAIN = {"math": "prose", "stem": "prose", "code": "code"}
DEFAULT_STYLE = "prose"
QUESTION_HEADER = "Read the options below and identify which one is correct. Respond with ONLY the letter of the correct option.\n\n"
QUESTION_FOOTER = "\n\nAnswer:"
TEMPLATES = {
    "prose": (
        "Paraphrase the following text. Preserve its exact meaning and approximate length "
        "and style. Output ONLY the paraphrased text with no preamble, quotes, or explanation.\n\n"
        "Text: {text}\n\nParaphrase:"
    ),
    "code": (
        "Rewrite the following code snippet in a different STYLE only: rename variables, adjust "
        "whitespace/formatting, and rephrase or remove comments as needed. You MUST preserve the "
        "exact logic, control flow, operators, and behavior — do NOT fix, change, or "
        "'improve' any bug or logic error present in the snippet, even if it looks incorrect. "
        "Output ONLY the restyled code with no preamble, quotes, or explanation.\n\n"
        "Code: {text}\n\nRestyled code:"
    ),
}
VERDICTS_SEPARABLE = {
    "strong": "**Strong authenticity artifact detected** (AUROC={auroc:.3f}).",
    "moderate": "**Moderate authenticity artifact detected** (AUROC={auroc:.3f}).",
    "none": "**No meaningful authenticity artifact detected overall** (AUROC={auroc:.3f}, near chance).",
}
VERDICTS_EXPLOITED = {
    "confirmed": "**Causal exploitation confirmed** overall: treatment gap ({t:.3f}) exceeds control ({c:.3f}), diff={diff:.3f}.",
    "weak": "**Weak/partial exploitation signal** overall: treatment ({t:.3f}) vs control ({c:.3f}), diff={diff:.3f}.",
    "none": "**No causal exploitation detected** overall: treatment ({t:.3f}) is not above control ({c:.3f}).",
}
MIN_SAVE_STEPS = 50
# End of fixed values.

"""Fixed values of the text format and of the search defaults.

They have to equal the published format (a transcribed 1611 Italian-English
dictionary) for the results to be right, so they are stated plainly here and
nowhere else.
"""

# --- Fixed values: segmentation -------------------------------------------
END_MARKER = "FINIS."
HEADING_PATTERN = "^[A-Z]+$"
MARK_SUBSTRINGS = (" _", ",_", "}")
MARK_PREFIXES = ("Fáre a guísa délla", "Vliuígn[o]")

# --- Fixed values: headword / definition split ----------------------------
COMMA_SPLIT_PREFIX = "Vliuígn[o]"
LAST_OR_PREFIXES = ("Deuére", "Precédere")
LAST_OR_PREFIX_WITH_COMMA_OR = "V[o]lére"
FIRST_MARK_PREFIX = "Fátt[o]"
HEADWORD_FIXES = (("<i>", "["), ("</i>", "]"), ("[er]", "er"))

# --- Fixed values: inflected forms ----------------------------------------
UNSPLIT_HEADWORDS = ("Fattaménte, si", "Marẻa, the", "Méschi[o],ed")
FORM_SEPARATORS = r",|_or_| or "
COMPOUND_PREFIX = "S[o]pra"
ACUTE_V_PREFIX = "V´"

# --- Fixed values: references ---------------------------------------------
ALPHABET_LISTING = "a, b, c"
LIST_PREFIX = "Picchi[ó]ne"

# --- Fixed values: search and reports -------------------------------------
SCORE_THRESHOLD = 0.75
TOP_K = 10
MAX_HITS = 20
UNEXPECTED_CHARACTERS = ("&", ",", "-", "?")
READY_KEY_GROUPS = 73_000
READY_PROBES = ("a", "xistone")
REPORT_TERMS = ("a", "abbellare", "Propórre", "Cóllerra")

# White space as the source format trims it: every Unicode space and separator.
WS = r"\t-\r\x{85}\p{Z}"

"""Values that results depend on. Everything here is a fixed value."""

# Resolution kinds and their confidences.
CLASS_SCOPED = ("class-scoped", 0.95)
IMPORT_SCOPED = ("import-scoped", 0.90)
PROBABLE = ("probable", 0.80)
AMBIGUOUS = ("ambiguous", 0.45)
UNRESOLVED = "unresolved"
EXACT_CONFIDENCE = 0.9
DISPLAY_CONFIDENCE = 0.8

# BM25 parameters and the floor used when idf is not positive.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6

# Rank fusion weights and bonuses.
RRF_K = 60.0
RRF_EXACT_WEIGHT = 1.5
RRF_TEXT_WEIGHT = 1.0
RRF_OCCURRENCE_WEIGHT = 0.3
RRF_TITLE_BONUS = 0.02
PROXIMITY_WEIGHT = 0.5
PROXIMITY_DEPTH = 3

# Limits of the public operations.
SEARCH_LIMIT, SEARCH_LIMIT_MAX = 8, 20
USAGES_LIMIT, USAGES_LIMIT_MAX = 10, 30
CALL_DEPTH_MAX = 4
FLOW_DEPTH_MAX = 2
STRUCTURAL_WINDOW = 150
MAX_FILE_BYTES = 2097152
BUDGET_CHARS = 12000
CONTEXT_CHARS = 10000

# Path fragments that mark a usage as noise.
NOISE_MARKERS = ("/test/", "/tests/", "/sample/", "/samples/", "/demo/", "/benchmark/", "/mock/")

# LIKE patterns that mark a path as a test file.
TEST_PATH_PATTERNS = (
    "%/tests/%", "%/test/%", "tests/%", "test/%",
    "%Test.%", "%Tests.%", "%Spec.%", "%_test.%", "%test_%",
)

# Supported file extensions and the language of each.
LANGUAGE_EXTENSIONS = {
    ".py": "python",
    ".java": "java",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".swift": "swift",
    ".md": "markdown",
    ".markdown": "markdown",
}

# Default exclude globs.
DEFAULT_EXCLUDES = (
    ".git/**", ".codeloom/**", "build/**", "dist/**", "node_modules/**",
    ".gradle/**", ".idea/**", ".venv/**", "__pycache__/**", "*.pyc",
)
DEFAULT_INCLUDES = ("**/*.py", "**/*.java", "**/*.kt", "**/*.kts", "**/*.md")

# File names and suffixes that are never served.
SENSITIVE_NAMES = (".env", ".env.local", ".env.production", "id_rsa", "id_ed25519")
SENSITIVE_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".keystore")

# Spellings never recorded as references.
REFERENCE_STOPLIST = (
    "if", "while", "for", "switch", "when", "catch", "new",
    "class", "super", "this", "self", "Object", "Any", "Unit", "Nothing",
)

# Texts of the rendered output.
BUDGET_NOTICE = "\n... [Output budget limit reached. Refine search or request sub-range]"
LINES_NOTICE = "\n... [Showing %d of %d %s. Refine query or request sub-range]"
BACK_REFERENCE = (
    "[Source for Symbol %s already provided in Turn %d (L%d-L%d). "
    "Omitted to preserve token budget. Pass force=True or call read_lines to inspect.]"
)
OMITTED = "... implementation omitted ..."
SKELETON_NOTICE = "\n\n... [Skeleton truncated at %d chars. Request specific symbols directly]"
SEMANTIC_MODE = "lexical-structural"

"""Default parameters. Results depend on them."""

# chunking
FLAT_SIZE, FLAT_OVERLAP = 700, 100
PARENT_SIZE = 2000
CHILD_SIZE, CHILD_OVERLAP = 400, 60
REFLOW_LIMIT = 4000

# retrieval
RRF_K = 60
CANDIDATES = 20
RERANK_TOP = 5
GRAPH_LIMIT = 10
GRAPH_NAMES = 8
GRAPH_SCORE = 0.5
CONTEXT_BUDGET = 6000
BM25_K1, BM25_B = 1.2, 0.75

# semantic cache
CACHE_THRESHOLD = 0.92
CACHE_TTL_DAYS = 7
CACHE_MIN_JACCARD = 0.8
CACHE_MAX_RATIO = 1.5
CACHE_QUESTION_CHARS = 2000

# contradictions
BAND_LOW, BAND_HIGH = 0.70, 0.95
BAND_PAIRS = 4

# graph: optional limits, see operators.graph_build.Limits; without them nothing is cut
PHRASES_PER_PARENT = 15
ENTITIES_PER_DOC = 200
RELATIONS_PER_DOC = 200
TYPED_RELATIONS_KEPT = 50
PAIRS_PER_CHUNK = 8
REPLY_ITEMS = 50
WINDOW_CHARS = 8000
MODEL_PARENTS = 60

# communities
SUMMARY_MEMBERS = 16
SUMMARY_TOP = 3
SNIPPET_CHARS = 220
GLOBAL_BUDGET = 8

# images
CAPTION_CHARS = 500
IMAGE_TAGS, TAG_CHARS = 10, 64
IMAGE_NAME_CHARS = 60
IMAGE_HITS = 3
CITED_SUMMARY_CHARS = 160

# ingest
MAX_FILE_BYTES = 50 * 1024 * 1024
EMBED_DIM = 64

# price per million tokens: model -> (prompt, completion)
PRICES = {
    "llama-3.3-70b-versatile": (0.59, 0.79),
    "llama-3.1-8b-instant": (0.05, 0.08),
    "gemini-2.5-flash": (0.30, 2.50),
}

# quality gate of the evaluation matrix
GATE = {"faithfulness": 0.90, "context_precision": 0.80, "citation_correctness": 1.0}

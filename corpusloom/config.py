"""Settings of ingestion and retrieval. They decide results."""

WINDOW_LINES, STRIDE_LINES = 60, 45
CHUNK_TOKEN_LIMIT = 512
MAX_CHUNKS_PER_FILE = 80
CODE_WINDOW_CAP, DOC_WINDOW_CAP, HTML_WINDOW_CAP = 40, 0, 20
NOTEBOOK_MAX_CELLS = 100
INGEST_MAX_TOTAL_CHUNKS = 3000
MAX_INDEX_FILE_BYTES = 2 << 20
PROBE_BYTES, PRINTABLE_RATIO = 8192, 0.85
EMBED_TEXT_CHARS, RERANK_TEXT_CHARS = 8000, 1920
DENSE_K, SPARSE_K, FINAL_K = 50, 50, 8
RRF_K, RRF_TOP = 60, 100
RERANK_THRESHOLD, DENSE_THRESHOLD = 0.10, 0.35
SMALL_CORPUS = 50
PROMPT_BUDGET = 2048 - 1200
MANIFEST_PATHS = 400
MANIFEST_PREFIX = "__manifest__/"
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
MAX_REPO_MB = 500
FLUSH = 32

LANGUAGES = {
    ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".go": "go", ".rs": "rust", ".md": "markdown", ".txt": "plaintext",
    ".jsx": "javascript", ".tsx": "typescript", ".yaml": "plaintext", ".yml": "plaintext", ".json": "plaintext", ".toml": "plaintext", ".ini": "plaintext",
    ".cfg": "plaintext", ".conf": "plaintext", ".sh": "plaintext", ".bash": "plaintext", ".html": "plaintext", ".htm": "plaintext", ".jinja": "plaintext",
    ".jinja2": "plaintext", ".ipynb": "notebook", ".csv": "plaintext", ".tsv": "plaintext", ".sql": "plaintext", ".r": "plaintext", ".xml": "plaintext",
    ".env": "plaintext", ".log": "plaintext", ".rst": "markdown", ".tex": "plaintext", ".bib": "plaintext", ".gradle": "plaintext", ".properties": "plaintext",
    ".css": "plaintext", ".scss": "plaintext", ".sass": "plaintext", ".less": "plaintext",
}
FILENAMES = {"dockerfile": "plaintext", "makefile": "plaintext", "jenkinsfile": "plaintext", "readme": "markdown"}
BINARY_EXTENSIONS = [
    ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".bmp", ".woff", ".woff2", ".ttf", ".eot", ".mp4", ".mp3", ".wav", ".zip", ".tar", ".gz", ".bz2", ".7z",
    ".pkl", ".pickle", ".joblib", ".h5", ".hdf5", ".keras", ".pt", ".pth", ".onnx", ".safetensors", ".parquet", ".exe", ".dll", ".so", ".dylib", ".pyc", ".pyo",
]
SKIP_DIRS = [".git", "node_modules", "__pycache__", "venv", ".venv", "dist", "build", "target", "coverage", ".tox", "vendor", ".next", "out"]
CODE_EXTENSIONS = [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".go", ".rs"]
HTML_EXTENSIONS = [".html", ".htm", ".jinja", ".jinja2"]
DOC_EXTENSIONS = [
    ".md", ".txt", ".yaml", ".yml", ".json", ".toml", ".ini", ".cfg", ".conf", ".sh", ".bash", ".csv", ".tsv", ".sql", ".r", ".xml", ".env", ".log", ".rst",
    ".tex", ".bib", ".gradle", ".properties", ".css", ".scss", ".sass", ".less",
]
REPO_ID = r"[a-f0-9]{8}"
URL_HOSTS = ["github.com", "gitlab.com", "bitbucket.org"]

#: Question patterns, matched without case. Fixed values.
TARGET_EXTENSIONS = ["md", "txt", "py", "js", "ts", "jsx", "tsx", "java", "go", "rs", "yaml", "yml", "json", "toml", "ini", "cfg", "sh", "bash", "html", "htm", "jinja", "jinja2"]
GREETING = r"^(hi|hello|hey|howdy|thanks|thank you|bye|goodbye|good morning|good afternoon|good evening|what(?:'s| is) your name|who are you)[!.?\s]*$"
STRUCTURE = (
    r"\b(what(?:'s|’s| is)?\s+(?:in|there in|inside)\s+(?:the\s+)?(?:repo(?:sitory)?|[\w./-]+(?:\s+(?:folder|directory|dir))?)"
    r"|what\s+files?|file\s+structure|list\s+files?|(?:show|tell me)\s+(?:the\s+)?(?:files?|contents?)|contents?\s+of"
    r"|(?:inside|in)\s+(?:the\s+)?[\w./-]+\s+(?:folder|directory|dir)|(?:overview|structure|layout|main\s+modules?|components)"
    r"|(?:files?|contents?)\s+(?:in|inside|under))\b"
)
FOLDER = (
    r"(?:(?:what(?:'s|’s| is)?\s+(?:in|there in|inside)\s+(?:the\s+)?)|(?:inside|in)\s+(?:the\s+)?|(?:files?\s+(?:in|inside|under)\s+(?:the\s+)?)|(?:contents?\s+of\s+(?:the\s+)?))"
    r"([\w./-]+?)(?:\s+(?:folder|directory|dir))?(?:\s|$|\?)"
)
STRUCTURE_PHRASES = r"(?:file|repo|repository|directory|project|code|folder) structure"
FOLDER_CUE = r"\b(?:folder|directory|dir)\b|[\w./-]+/"
NOT_FOLDERS = ["repo", "repository", "codebase", "project", "this", "that", "these", "those", "whole", "entire", "all", "readme", "the", "structure"]

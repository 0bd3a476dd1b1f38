"""Names, limits and schemas of the pattern bank."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

# Fixed values of the data model.
CATEGORIES = ["architecture", "error_handling", "configuration", "testing", "api_design", "data_access", "security", "logging", "utilities", "other"]
LANGUAGES = ["python", "java", "javascript", "typescript", "go", "unknown"]
EXTENSIONS = {".py": "python", ".java": "java", ".js": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".go": "go"}
IGNORED_DIRS = [".git", "node_modules", "venv", "__pycache__", "dist", "build", "target", ".idea", ".vscode", "vendor", "deps", ".gradle", "bin", "obj"]
LOCAL_IGNORED_DIRS = [d for d in IGNORED_DIRS if d != "deps"]
EXCLUDED_REPOS = ["dotfiles", "archived-*", "*.github.io"]
STOP_WORDS = ["def", "class", "if", "else", "for", "while", "return", "import", "from", "as", "try", "except", "with", "in", "is", "not", "and", "or", "the", "a", "an", "to", "of", "it", "be", "at", "by", "on"]
MODELS = {"jinaai/jina-embeddings-v2-base-code": 768, "BAAI/bge-base-en-v1.5": 768, "BAAI/bge-small-en-v1.5": 384, "sentence-transformers/all-MiniLM-L6-v2": 384, "nomic-ai/nomic-embed-text-v1.5": 768}
PROJECT_WORDS = {"api": "REST API endpoint controller service", "cli": "command line argument parser", "library": "module package utility", "web-app": "web application frontend backend"}

MIN_LINES, MAX_LINES, OVERLAP_LINES = 5, 150, 10
PREVIEW = 500
LARGE_REPO_FILES = 50
BATCH_FILES = 10
SEMANTIC_WEIGHT, KEYWORD_WEIGHT = 0.7, 0.3
OVERFETCH, CANDIDATE_CAP = 3, 50
TTL = {"repos": 300.0, "repo": 300.0, "tree": 600.0, "content": 3600.0}
DEFAULT_TTL = 300.0

PAYLOAD = ["title", "description", "category", "language", "quality_score", "source_repo", "source_path", "use_cases"]

BANK = StructType(
    [
        StructField("point_id", StringType(), False),
        StructField("document", StringType()),
        StructField("title", StringType()),
        StructField("description", StringType()),
        StructField("category", StringType()),
        StructField("language", StringType()),
        StructField("quality_score", IntegerType()),
        StructField("source_repo", StringType()),
        StructField("source_path", StringType()),
        StructField("use_cases", ArrayType(StringType())),
        StructField("embedding", ArrayType(FloatType())),
        StructField("ingest_seq", LongType()),
    ]
)

CACHE = StructType([StructField("key", StringType()), StructField("value", StringType()), StructField("expires_at", DoubleType()), StructField("access_seq", LongType())])

CHUNK = "chunk_no int, content string, start_line int, end_line int, chunk_type string, name string, context string"
ANALYSIS = StructType(
    [
        StructField("is_pattern", BooleanType()),
        StructField("title", StringType()),
        StructField("description", StringType()),
        StructField("category", StringType()),
        StructField("quality_score", IntegerType()),
        StructField("use_cases", ArrayType(StringType())),
    ]
)

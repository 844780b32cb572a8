"""Fixed values that decide results."""

from __future__ import annotations

# Names, patterns and thresholds that results must agree on.
EXCLUDE_DIR_NAMES = (
    "Windows", "Program Files", "Program Files (x86)", "ProgramData", "AppData", "$Recycle.Bin", "System Volume Information",
    "node_modules", ".git", ".svn", "__pycache__", ".venv", "venv", "_정리보관",
)
EXCLUDE_FILE_GLOBS = ("*.tmp", "*.temp", "~$*", "*.lnk", "desktop.ini", "*.sys", "*.part", "*.crdownload")
JUNK_GLOBS = (
    ".DS_Store", "._*", ".AppleDouble", ".LSOverride", ".Spotlight-V100", ".Trashes", ".fseventsd", ".TemporaryItems",
    ".apdisk", ".localized", "__MACOSX", "Thumbs.db", "ehthumbs.db",
)
MIN_SIZE_BYTES = 102_400
VERSION_KEYWORDS = (
    "원본", "초안", "draft", "v1", "구버전", "old", "수정", "revised", "rev", "v2", "v3", "최종", "final", "fin",
    "진짜최종", "finalfinal", "real_final", "최종본", "최최종",
)
FAMILY_KEYWORDS = ("최종", "최신", "진짜", "real", "final", "fin", "수정", "revised", "rev", "초안", "draft", "원본", "구버전", "old", "본", "최최종")
PENALTY_WORDS = ("download", "다운로드", "temp", "임시", "tmp", "cache", "캐시", "$recycle", "복사본", "정리보관", "_정리보관", "new folder", "새 폴더")
COPY_STEM = r"복사본|사본|copy|\(\d+\)|\d+\s*$|- ?copy"
VERSION_NUMBER = r"(?:^|[ _\-.(\[])v\.?\s?(\d{1,3})\b"
PAREN_NUMBER = r"\((\d{1,3})\)"
TRAILING_NUMBER = r"[ _\-](\d{1,3})\s*$"
DATE_TOKEN = r"(20\d{2})[._\-]?(0[1-9]|1[0-2])[._\-]?(0[1-9]|[12]\d|3[01])"
COPY_TOKEN = r"복사본|사본|copy|-\s*복사본"
IMAGE_EXTS = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".tif", ".heic", ".heif", ".avif", ".jfif", ".ico")
DOCZIP_EXTS = (".docx", ".pptx", ".xlsx", ".odt", ".ods", ".odp", ".hwpx")
PDF_EXTS, HWP_EXTS = (".pdf",), (".hwp",)
PLAINTEXT_EXTS = (
    ".txt", ".md", ".csv", ".tsv", ".log", ".json", ".xml", ".yaml", ".yml", ".ini", ".cfg", ".py", ".java", ".js", ".ts", ".jsx", ".tsx", ".html",
    ".htm", ".css", ".scss", ".c", ".cpp", ".cc", ".h", ".hpp", ".cs", ".go", ".rb", ".php", ".sql", ".sh", ".bat", ".ps1", ".r", ".kt", ".swift", ".rs",
)
ZIP_EXTS, SEVENZIP_EXTS = (".zip", ".jar", ".war", ".apk", ".epub"), (".7z",)
VIDEO_EXTS = (".mp4", ".mov", ".avi", ".mkv", ".wmv", ".flv", ".webm", ".m4v", ".mpg", ".mpeg", ".ts", ".3gp", ".m2ts")
RAW_EXTS = (".dng", ".cr2", ".cr3", ".nef", ".arw", ".orf", ".rw2", ".raf", ".srw", ".pef", ".raw")
AUDIO_EXTS = (".mp3", ".flac", ".m4a", ".aac", ".wav", ".ogg", ".wma", ".opus")
TEXT_NEAR_THRESHOLD, IMAGE_THRESHOLD, VIDEO_THRESHOLD = 0.5, 6, 40
AUDIO_BER, AUDIO_LOCAL_THRESHOLD, AUDIO_LEGACY_THRESHOLD = 0.10, 40, 10
NO_EXTENSION = "(없음)"
EXPORT_COLUMNS = ("category", "category_title", "group", "role", "path", "name", "folder", "size_bytes", "size_human", "mtime_iso")
